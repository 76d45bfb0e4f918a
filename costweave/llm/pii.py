"""Personal data in texts, with built-in column functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, modulo 97 for account numbers, ranges
and digit counts for the rest), and words near a span move its score. Offsets are code points, end exclusive.

A kind's matches are leftmost and do not overlap; one that fails its check is dropped and not tried again in
parts; an account number ends where its country's numbers do. The patterns never re-scan a run of characters: look-behinds let a match start only where a run starts
(or where the last match ended), and possessive repeats do not go back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave.llm.shared import free_name

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: characters of an account number by country (fixed values, ISO 13616 registry)
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BF BI BJ CF CG CI CM CV DJ FR GA GR IR IT KM MC MG ML MR NE SM SN TD TG", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _of_length(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    last = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{last}(?![A-Za-z0-9])"


# the length of the country's numbers first; other lengths and countries as far as the characters go
IBAN = (
    r"(?<![A-Za-z0-9])(?:" + "|".join(_of_length(n, c) for n, c in IBAN_LENGTHS.items())
    + r"|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
)

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban"]
SPAN = "array<struct<start:int,end:int,kind:string,score:double>>"
NEAR = 40  # characters before and after a span, up to the next match, that are searched for context
BLOCK = 64  # matches whose offsets are summed up together
LEAST_SCORE = 0.5  # for the kinds beyond the base
STARTING_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8}
HELPING = {
    "email": r"\b(?:e-?mail|mail|contact|write)\b", "ip": r"\b(?:ip|host|server|client|address)\b",
    "card": r"\b(?:card|visa|credit|mastercard|pay|payment)\b", "phone": r"\b(?:phone|tel|call|mobile|fax|telefon)\b",
    "iban": r"\b(?:iban|account|bank|konto|transfer)\b",
}
HINDERING = r"\b(?:order|serial|version|invoice|isbn|ticket|build|sample|example)\b"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_ip(value: Column) -> Column:
    def small(part):
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(value, r"\."), small)


def _is_card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[ -]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def _is_iban(value: Column) -> Column:
    bare = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))

    def step(rest, char):
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.length(bare).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


#: kind: (what a text must have at all, pattern, check)
RULES = {
    "email": (lambda t: t.contains("@"), EMAIL, None),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), IP, _is_ip),
    "card": (lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), CARD, _is_card),
    "phone": (lambda t: t.contains("+"), PHONE, _is_phone),
    "iban": (lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), IBAN, _is_iban),
}


def _pairs(gaps: Column, hits: Column) -> Column:
    """array<struct<gap, hit, next>>: every match with the text before it and the text after it."""
    both = F.zip_with(gaps, hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    after = F.slice(gaps, F.lit(2), F.size(gaps))
    whole = F.zip_with(both, after, lambda x, n: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), n.alias("next")))
    return F.slice(whole, F.lit(1), F.size(hits))


def _blocks(pairs: Column, kind: str) -> Column:
    """Spans of every run of BLOCK matches with offsets from the run's start, and the run's length."""

    def step(done, pair):
        start = done["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        near = F.lower(F.concat_ws(" ", F.substring(pair["gap"], -NEAR, NEAR), F.substring(pair["next"], 1, NEAR)))
        score = F.lit(STARTING_SCORE[kind]) + F.when(near.rlike(HELPING[kind]), 0.2).otherwise(0.0)
        score = F.least(score - F.when(near.rlike(HINDERING), 0.4).otherwise(0.0), F.lit(1.0))
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score"))
        check = RULES[kind][2]
        valid = check(pair["hit"]) if check else F.lit(True)
        if kind not in BASE:
            valid = valid & (score >= LEAST_SCORE)
        return F.struct(end.alias("at"), F.when(valid, F.concat(done["out"], F.array(span))).otherwise(done["out"]).alias("out"))

    def run(number):
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(F.slice(pairs, number * BLOCK + 1, F.lit(BLOCK)), start, step)

    none = F.array().cast(f"array<struct<at:int,out:{SPAN}>>")
    return F.when(F.size(pairs) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), run)).otherwise(none)


def _joined(blocks: Column) -> Column:
    """The runs one after the other: offsets from the start of the text."""

    def step(done, block):
        moved = F.transform(block["out"], lambda x: F.struct(
            (x["start"] + done["at"]).alias("start"), (x["end"] + done["at"]).alias("end"), x["kind"].alias("kind"), x["score"].alias("score"),
        ))
        return F.struct((done["at"] + block["at"]).alias("at"), F.concat(done["out"], moved).alias("out"))

    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step)["out"]


def _with_spans(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with the text (NULL: empty) and an array of confirmed spans for each kind; the names of these columns.

    Each step stands in a column of its own, read more than once, so that no pattern runs twice.
    """
    whole = free_name(docs, "_whole")
    df = docs.withColumn(whole, F.coalesce("text", F.lit("")))
    names = [free_name(docs, f"_{kind}") for kind in KINDS]
    parts = {n: (free_name(docs, f"{n}_gaps"), free_name(docs, f"{n}_hits")) for n in names}
    columns = {}
    for name, kind in zip(names, KINDS):
        may, pattern, _ = RULES[kind]
        gaps, hits = parts[name]
        columns[gaps] = F.when(may(F.col(whole)), F.split(whole, pattern, -1)).otherwise(F.array().cast("array<string>"))
        columns[hits] = F.when(may(F.col(whole)), F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumns(columns)
    df = df.withColumns({n: _pairs(F.col(gaps), F.col(hits)) for n, (gaps, hits) in parts.items()})
    df = df.withColumns({n: _blocks(F.col(n), kind) for n, kind in zip(names, KINDS)})
    df = df.withColumns({n: _joined(F.col(n)) for n in names})
    return df.select(*docs.columns, whole, *names), [whole, *names]


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores of every row; no shuffle.

    spans: kind:start:end, by kind (email, ip, card, phone, iban), then start; scores: theirs, in that order.
    A NULL text is empty; repeated rows give equal rows; columns beyond doc_id and text are not read.
    """
    df, (_, *names) = _with_spans(docs.select("doc_id", "text"))

    def told(columns):
        return F.transform(F.concat(*columns), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))

    return df.select(
        "doc_id",
        *[F.size(n).cast("long").alias(f"n_{kind}") for n, kind in zip(names, BASE)],
        F.sha2(F.concat_ws(",", told(names[: len(BASE)])), 256).alias("base_sha256"),
        F.concat_ws(",", told(names)).alias("spans"),
        F.concat_ws(",", F.transform(F.concat(*names), lambda x: F.format_number(x["score"], 2))).alias("scores"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets, and n_chars, if there, set anew.

    Overlapping spans become one mark, that of the first. Rows without spans stay as they are, NULL texts too.
    """
    df, (whole, *names) = _with_spans(docs)

    def step(done, span):
        inside = span["start"] >= done["at"]
        out = F.when(inside, F.concat(
            done["out"], F.substring(F.col(whole), done["at"] + 1, span["start"] - done["at"]), F.lit("<"), span["kind"], F.lit(">"),
        )).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), out.alias("out"))

    every = F.array_sort(F.concat(*names))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(every, start, step, lambda x: F.concat(x["out"], F.substring(F.col(whole), x["at"] + 1, F.length(whole))))
    hits = sum((F.size(n) for n in names[1:]), F.size(names[0]))
    df = df.withColumn("text", F.when(hits > 0, masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(hits > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.select(*docs.columns)
