"""Personal data, languages, toxicity, benchmark items and transcripts: brute force, or held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from costweave.llm import chat, decontam, language, pii, textops, toxicity

SF = "/root/testdata/sf0.001"

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = int(d) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def test_personal_data_matches_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1.2@+-5 ()\n9é😀Z0,") for _ in range(rng.randint(0, 80))) for _ in range(600)]
    texts += [
        None, "", "a@b.c@d.e", "a@b.com_x@y.com", "1.2.3.4.5.6.7.8", "+1 (017) 555-7713", "4111 1111 1111 1111 or 4111-1111-1111-1112",
        "0000255.1.1.00 256.1.1.1", "a" * 3000, "1" * 3000, "1." * 2000, "1 " * 3000, "x@y.zz " * 900, "+1" * 900,
    ]
    rows = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    found = {r["doc_id"]: r for r in pii.detect(rows).collect()}
    for i, text in enumerate(texts):
        base = base_spans(text)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert found[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest(), text
        assert [found[i][f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert found[i]["spans"] == told


def test_account_numbers_and_context(spark):
    texts = ["my iban DE89 3704 0044 0532 0130 00 ok", "DE88 3704 0044 0532 0130 00", "order version GB82WEST12345698765432 sample"]
    found = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["spans"] for r in found] == ["iban:8:35", "", ""]
    scores = [pii.detect(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()["scores"] for t in (
        "call 1.2.3.4", "the host 1.2.3.4", "version 1.2.3.4")]
    assert float(scores[2]) < float(scores[0]) < float(scores[1])


def test_account_numbers_end_where_their_country_says(spark):
    numbers = [
        "BE71 0961 2345 6769", "ES9121000418450200051332", "AT61 1904 3002 3457 3201", "SE45 5000 0000 0583 9825 7466",
        "PL61 1090 1014 0000 0712 1981 2874", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S",
    ]
    rows = [f"{n} {after}" for n in numbers for after in ("EUR 100", "BIC X", "2024 A", "DE89 3704 0044 0532 0130 00", "ok")]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in pii.detect(df).collect():
        number = numbers[r["doc_id"] // 5]
        spans = [f"iban:0:{len(number)}"] + [f"iban:{len(number) + 1}:{len(number) + 28}"] * ("DE89" in rows[r["doc_id"]])
        assert [s for s in r["spans"].split(",") if s.startswith("iban")] == spans, rows[r["doc_id"]]
    assert all(r["text"].startswith("<iban> ") for r in pii.redact(df).collect())


def test_redaction(spark):
    rows = [(1, "é mail a@b.cc, +1 (017) 555-7713", 32, 0), (2, None, None, 0), (3, "clean", 99, 0), (None, "1.2.3.4; 4111111111111111", 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _email int")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()} == {
        (1, "é mail <email>, <phone>", 23), (2, None, None), (3, "clean", 99), (None, "<ip>; <card>", 12),
    }
    assert pii.redact(df.limit(0)).collect() == [] and pii.detect(df.limit(0)).collect() == []


def test_languages_are_told_apart_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    found = language.identify(docs).collect()
    assert len(found) == len(truth)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_edges(spark):
    rows = [(0, "das ist ein Wort und noch eins", "de", "x"), (2, "the word is this and that", "en", "x"), (3, "le mot est celui de la fin", None, "x")]
    rows += [(4, None, "en", "x"), (5, "", "de", "x"), (6, "12 !? ½", "de", "x"), (7, "é", "en", "x"), (None, "the word", "en", "x"), (0, rows[0][1], "de", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    found = language.identify(df).collect()
    assert [r["lang_pred"] for r in found if r["doc_id"] in (4, 5, 6)] == ["und"] * 3
    assert all(r["lang_pred"] in ("de", "en") for r in found if r["doc_id"] not in (4, 5, 6))
    assert {r["lang_pred"] for r in language.identify(df.withColumn("lang", df["lang"].substr(9, 1)).replace("", None, ["lang"])).collect()} == {"und"}
    assert language.identify(df.limit(0)).collect() == []


def test_features_of_long_texts_in_parts():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 3_000_000).astype(np.uint8)
    offsets = np.array([0, 2_500_000, 2_500_000, 3_000_000])
    counts = language.counts(data, offsets)
    assert counts.sum(axis=1).tolist() == [3 * 2_500_000 - 3, 0, 3 * 500_000 - 3]


def test_toxic_words_are_learned(spark):
    rng = random.Random(9)
    plain, toxic = [f"w{k}" for k in range(80)], ["awful", "vile"]
    rows, labels = [], []
    for k in range(1500):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 40))]
        bad = rng.random() < 0.15
        if bad:
            words[rng.randrange(len(words))] = rng.choice(toxic).upper()
        rows.append((k, " ".join(words), bad))
        if k % 3:
            labels.append((k, 1, int(bad)))
    rows += [(-1, None, False), (-2, "", False), (None, "vile", True)]
    labels += [(5, None, None), (None, 0, 1), (-1, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.grade(docs, known).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(found) == len(rows) and all(r["toxic"] == truth[r["doc_id"]] for r in found)
    assert all(0 <= r["p_toxic"] <= r["expected_severity"] <= 2 for r in found)
    none = toxicity.grade(docs, known.limit(0)).collect()
    assert not any(r["toxic"] for r in none)
    assert toxicity.grade(docs.limit(0), known).collect() == []


def test_thresholds_share_weights_and_are_ordered():
    model = toxicity.OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([-1.0, 2.0]))
    above = model.exceeds(np.array([-3.0, 0.0, 3.0]))
    assert (np.diff(above, axis=0) > 0).all() and (above[:, 0] > above[:, 1]).all()


def brute_alignment(item, words):
    best = np.zeros((len(item) + 1, len(words) + 1), int)
    for i, a in enumerate(item):
        for j, b in enumerate(words):
            best[i + 1, j + 1] = max(0, best[i, j] + (2 if a == b else -1), best[i, j + 1] - 1, best[i + 1, j] - 1)
    return best.max()


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(4)
    for _ in range(60):
        item, words = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 25))
        assert decontam.align(item, words)[0] == brute_alignment(item, words)


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_contaminated_documents(spark, block_words, monkeypatch):
    monkeypatch.setattr(decontam.item_blocks, "__defaults__", (block_words,))
    rng = random.Random(2)
    word = lambda: f"v{rng.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([30, 30, 12, 3])] + [(4, "Solo"), (7, None), (8, ""), (9, "?!")]
    filler = lambda n: " ".join(f"f{rng.randrange(900)}" for _ in range(n))
    edited = items[1][1].split()
    edited[5] = edited[17] = "changed"
    del edited[11]
    texts = {
        0: filler(60), 1: f"{filler(30)} {items[0][1].upper()}, {filler(9)}", 2: f"{filler(5)} {' '.join(edited)} {filler(40)}",
        3: items[2][1].replace(" ", "\n"), 4: None, 5: "", 6: " ".join(items[0][1].split()[:5]) + filler(50), 8: items[3][1],
        9: f"{items[0][1]} {filler(3)} {items[2][1]}",
    }
    df = spark.createDataFrame([(k, t, 1.0) for k, t in texts.items()], "doc_id long, text string, score double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(df, bench).collect()}
    assert set(found) == {(1, 0), (2, 1), (3, 2), (8, 3), (9, 0), (9, 2)}
    assert found[1, 0] == found[3, 2] == 1.0 and 0.7 < found[2, 1] < 1.0
    kept = decontam.remove_contaminated(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {0, 4, 5, 6}
    assert decontam.contaminated(df, bench.limit(0)).collect() == [] and decontam.contaminated(df.limit(0), bench).collect() == []
    assert decontam.remove_contaminated(df, bench.limit(0)).count() == len(texts)


@pytest.mark.parametrize("verbatim", [False, True])
def test_edited_copies_are_found_like_by_full_alignment(spark, verbatim, monkeypatch):
    rng = random.Random(6)
    items = [(k, " ".join(f"v{rng.randrange(500)}" for _ in range(40))) for k in range(6)]
    filler = lambda n: [f"f{rng.randrange(200)}" for _ in range(n)]
    texts = [" ".join(filler(60))] + [text for _, text in items if verbatim]
    for _, text in items:
        for every in (4, 5, 6):
            for first in range(every):
                copy = text.split()
                copy[first::every] = filler(len(copy[first::every]))
                texts.append(" ".join(filler(rng.randint(0, 30)) + copy + filler(rng.randint(0, 30))))
        words = text.split()
        texts.append(" ".join(filler(7) + words[:20] + filler(30) + words[20:] + filler(9)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    wanted = {}
    for d, text in enumerate(texts):
        for i, item in items:
            item, words = item.split(), text.split()
            if len(set(item) & set(words)) >= 20:  # fewer cannot reach half
                wanted[d, i] = brute_alignment(item, words) / (2 * len(item))
    assert found == {pair: score for pair, score in wanted.items() if score >= 0.5} and len(found) >= 6 * 16
    data, offsets = textops.byte_column(pa.array(texts))
    block = decontam.ItemBlock(*zip(*items))
    whole = block.matches(data, offsets)
    monkeypatch.setattr(decontam, "HITS", 50)
    assert block.matches(data, offsets) == whole and sum(map(len, whole)) == len(found)


def edits(words, filler):
    yield [x for k, w in enumerate(words) for x in ([w, filler()] if k % 2 else [w])]  # a word after every second
    yield [x for w in words for x in (w, filler())]  # and after every word
    for every in range(2, 7):
        for first in range(every):
            yield [filler() if k % every == first else w for k, w in enumerate(words)]
            yield [w for k, w in enumerate(words) if k % every != first]
    half = len(words) // 2
    yield words[:half] + [filler() for _ in range(half)] + words[half:]
    yield words[half:] + words[:half]


@pytest.mark.parametrize("length", [4, 5, 6, 8, 11, 20, 40])
def test_no_edited_copy_is_lost(length):
    rng = random.Random(length)
    vocabulary = 15 if length == 11 else 400  # words that repeat within items, too
    items = [(k, " ".join(f"v{rng.randrange(vocabulary)}" for _ in range(length))) for k in range(3)]
    items += [(k, "which of the following " + " ".join(f"u{rng.randrange(90)}" for _ in range(length))) for k in range(3, 60)]
    filler = lambda: f"f{rng.randrange(300)}"
    texts = [[filler() for _ in range(9)] + copy + [filler() for _ in range(9)] for _, t in items[:4] for copy in edits(t.split(), filler)]
    texts += [["which", "of", "the", "following", filler()] * 5]
    data, offsets = textops.byte_column(pa.array([" ".join(t) for t in texts]))
    found = decontam.ItemBlock(*zip(*items)).matches(data, offsets)
    for text, matches in zip(texts, found):
        scores = {i: brute_alignment(t.split(), text) / (2 * len(t.split())) for i, t in items if 2 * len(set(t.split()) & set(text)) >= len(set(t.split()))}
        assert {m["item_id"]: m["score"] for m in matches} == {i: s for i, s in scores.items() if s >= 0.5}


def brute_states(model, values):
    best, back = model.start + values[0], []
    for value in values[1:]:
        ways = best[:, None] + model.move
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + value
    states = [int(best.argmax())]
    for way in reversed(back):
        states.append(int(way[states[-1]]))
    return states[::-1]


def test_blocks_decode_like_one_pass():
    rng = np.random.default_rng(7)
    size = len(chat.STATES)
    model = chat.RoleModel(rng.normal(size=size), rng.normal(size=(size, size)), [])
    values = rng.normal(size=(50, size)) * 2
    cuts = [0, 7, 8, 30, 50]
    value, ways = np.zeros(1), []
    for a, b in zip(cuts[:-1], cuts[1:]):
        table = value[:, None] + model.across(values[a:b], a == 0).reshape(-1, size)
        ways.append(table.argmax(axis=0))
        value = table.max(axis=0)
    end, states = int(value.argmax()), []
    for k in reversed(range(4)):
        before = int(ways[k][end])
        states = model.decode(values[cuts[k] : cuts[k + 1]], before if k else None, end) + states
        end = before
    assert states == brute_states(model, values)


def test_transcript_roles_on_held_out_conversations(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    wild = chat.as_transcripts(rows)
    model = chat.train(wild.where("conv_id % 2 = 0"))
    held = wild.where("conv_id % 2 = 1")
    truth = {(r["conv_id"], r["turn"]): r["role"] for r in held.collect()}
    for block_turns in (128, 2):
        found = chat.parse(held.drop("role"), model, block_turns=block_turns).collect()
        roles = {(r["conv_id"], r["first_turn"]): r["role"] for r in found}
        assert sum(roles.get(k) == v for k, v in truth.items()) >= 0.93 * len(truth)
        assert all(r["rendered"] == f"<|{r['role']}|>\n{r['text']}" for r in found)


def test_transcript_edges(spark):
    labelled = spark.createDataFrame(
        [(c, t, ["user", "assistant"][t % 2], ["User: why?", "Assistant: so it is"][t % 2]) for c in range(30) for t in range(4)],
        "conv_id long, turn long, role string, text string",
    )
    model = chat.train(labelled)
    rows = [(1, 0, "User: hi?", 1), (1, 1, "Assistant: yes", 1), (1, 1, "Assistant: yes", 1), (2, None, None, 1), (None, 3, "AI: x", 1), (3, 5, "", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role int")
    found = chat.parse(df, model).collect()
    assert {r["conv_id"] for r in found} == {1, 2, 3, None}
    first = [r for r in found if r["conv_id"] == 1]
    assert (first[0]["role"], first[0]["text"]) == ("user", "hi?")
    assert chat.parse(df.limit(0), model).collect() == []
    assert chat.train(labelled.limit(0)) is None


def test_pipeline_keeps_columns_and_drops_what_it_should(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copy = docs.orderBy("doc_id").limit(1).withColumn("doc_id", docs["doc_id"] + 1_000_000)
    odd = spark.createDataFrame([(2_000_000, None, "en", "s", 0), (2_000_001, "12 34", "en", "s", 5)], docs.schema)
    rows = docs.unionByName(copy).unionByName(odd)
    wanted = {r["doc_id"] for r in rows.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        before = rows
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns, name
        assert {r["doc_id"] for r in rows.collect()} <= {r["doc_id"] for r in before.collect()}
    kept = {r["doc_id"] for r in rows.collect()}
    assert not kept & {1_000_000, 2_000_000, 2_000_001} and len(kept) > 0.5 * len(wanted)
    assert not any(base_spans(r["text"]) for r in rows.collect())
    packed = pipeline.pack_sequences(spark, rows, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept
    final = pipeline.run(spark, SF)
    assert final.columns == packed.columns and final.count() > 0
