"""Language of texts: the family first, then one-versus-one linear support vector machines inside it.

Features are shares of hashed runs of one to three bytes over letters (other bytes count as one gap), as
square roots, of unit length. Fitting uses at most `per_language` labelled rows a language, the ones with
the least hash of their doc_id; predicting reads every whole text and needs no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave.llm import textops
from costweave.llm.shared import fit_in_task

WIDTH = 4096
PER_LANGUAGE = 600
PART_ROWS = 512  # rows measured at once: 16 MB of counts
MOST_LANGUAGES = 200
UNKNOWN = "und"
#: families of related languages (fixed values); a language in none of them is its own family
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ca", "gl", "ro"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
    "baltic": ["lt", "lv"], "uralic": ["fi", "et", "hu"], "celtic": ["ga", "cy", "gd", "br"],
    "indo-aryan": ["hi", "ur", "bn", "mr", "gu", "pa", "ne"], "turkic": ["tr", "az", "kk", "uz"],
}

_CODES = np.zeros(256, np.uint32)
_CODES[0x61:0x7B] = np.arange(1, 27)
_CODES[0x80:] = np.arange(27, 155)
_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LETTER.search(text)) or any(map(str.isalpha, text)))


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed byte runs, a row for each text; long texts are counted in parts."""
    rows = len(offsets) - 1
    out = np.zeros((rows, WIDTH))
    for first, last in textops.blocks(offsets, 1 << 18):
        for low in range(int(offsets[first]), int(offsets[last]), 1 << 20):
            # parts of a long text overlap by two bytes, so that every run is counted once
            part = _CODES[textops.LOWER[data[max(low - 2, int(offsets[first])) : min(low + (1 << 20), int(offsets[last]))]]]
            shift = low - max(low - 2, int(offsets[first]))
            at = np.arange(len(part)) + low - shift
            row = np.searchsorted(offsets[first : last + 1], at, side="right") - 1
            for size in (1, 2, 3):
                code = part[size - 1 :].astype(np.uint64)
                for back in range(1, size):
                    code = code + part[size - 1 - back : len(part) - back].astype(np.uint64) * np.uint64(155**back)
                same = row[size - 1 :] == row[: len(row) - size + 1]
                same &= at[size - 1 :] >= low  # counted where the run ends
                slot = (textops.mix(code[same] * np.uint64(4) + np.uint64(size)) % np.uint64(WIDTH)).astype(np.int64)
                out[first:last] += np.bincount(row[size - 1 :][same] * WIDTH + slot, minlength=(last - first) * WIDTH).reshape(last - first, WIDTH)
    return out


def _parts(offsets: np.ndarray):
    """Ranges of rows whose texts and features are of bounded size, but for a single long text."""
    for first, last in textops.blocks(offsets):
        for low in range(first, last, PART_ROWS):
            yield low, min(low + PART_ROWS, last)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = counts(data, offsets)
    out = np.sqrt(out, out=out).astype(np.float32)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    out /= np.where(length == 0, 1, length)
    return out


def fit_svm(x: np.ndarray, positive: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights (and bias last) of a linear SVM with squared hinge loss, by accelerated descent; classes weigh the same."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    weight = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)).astype(np.float32)
    now = past = np.zeros(x.shape[1] + 1, np.float32)
    rate = 1 / (2 * (1 + 1) + penalty)  # rows have unit length, and the bias adds one
    for step in range(steps):
        ahead = now + (step / (step + 3)) * (now - past)
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        pull = -2 * weight * y * slack
        slope = np.append(x.T @ pull, pull.sum()) + penalty * np.append(ahead[:-1], 0)
        past, now = now, ahead - rate * slope.astype(np.float32)
    return now


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[list[int]]  # languages of each family
    family_weights: np.ndarray  # a column for each family, bias last
    pairs: list[tuple[int, int]]
    pair_weights: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score from 0 to 1) of each row of features."""
        rows = np.arange(len(x))
        chance = 1 / (1 + np.exp(-2 * (x @ self.family_weights[:-1] + self.family_weights[-1])))
        family = chance.argmax(axis=1)
        votes = np.zeros((len(x), len(self.languages)))
        sure = np.ones((len(x), len(self.languages)))
        margins = x @ self.pair_weights[:-1] + self.pair_weights[-1]
        for k, (a, b) in enumerate(self.pairs):
            likely = 1 / (1 + np.exp(-2 * margins[:, k]))
            # a vote, and the margin to part ties
            votes[:, a] += (likely >= 0.5) + likely * 1e-3
            votes[:, b] += (likely < 0.5) + (1 - likely) * 1e-3
            sure[:, a] = np.minimum(sure[:, a], likely)
            sure[:, b] = np.minimum(sure[:, b], 1 - likely)
        member = np.zeros((len(self.families), len(self.languages)), bool)
        for k, own in enumerate(self.families):
            member[k, own] = True
        best = np.where(member[family], votes, -1.0).argmax(axis=1)
        score = sure[rows, best]
        if len(self.families) > 1:
            score = score * chance[rows, family]
        return best, score


def fit_model(sample: pd.DataFrame) -> LanguageModel:
    """From rows (lang, x: features as bytes)."""
    languages = sorted(set(sample["lang"]))
    x = np.stack([np.frombuffer(r, np.float32) for r in sample["x"]])
    y = sample["lang"].map({code: k for k, code in enumerate(languages)}).to_numpy()
    order = np.lexsort((*x[:, :16].T, y))  # the order of the rows must not matter
    x, y = x[order], y[order]
    family_of = {code: name for name, codes in FAMILIES.items() for code in codes}
    names = [family_of.get(code.split("-")[0].lower(), f"only {code}") for code in languages]
    families = [[k for k, n in enumerate(names) if n == name] for name in sorted(set(names))]
    family = np.array([next(k for k, own in enumerate(families) if c in own) for c in range(len(languages))])
    family_weights = np.stack([fit_svm(x, family[y] == k) for k in range(len(families))], axis=1)
    pairs = [pair for own in families for pair in combinations(own, 2)]
    weights = [fit_svm(x[(y == a) | (y == b)], y[(y == a) | (y == b)] == a) for a, b in pairs]
    pair_weights = np.stack(weights, axis=1) if weights else np.zeros((WIDTH + 1, 0), np.float32)
    return LanguageModel(languages, families, family_weights, pairs, pair_weights)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Fit on rows (doc_id, text, lang); rows without text or lang are left out. None if nothing is left.

    Bounded sample: about `per_language` rows of each language, chosen by the hash of doc_id; more than
    200 languages raise ValueError.
    """
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    totals = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not totals:
        return None
    share = F.create_map(*[F.lit(v) for r in totals for v in (r["lang"], min(1.0, per_language / r["n"]))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def measure(batches):
        for batch in batches:
            data, offsets = textops.byte_column(batch.column(0))
            for first, last in _parts(offsets):
                part = offsets[first : last + 1]
                x = features(data[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(first, last - first), pa.array([r.tobytes() for r in x], pa.binary()),
                ], names=["lang", "x"])

    sample = chosen.select("text", "lang").mapInArrow(measure, "lang string, x binary")
    return fit_in_task(sample.limit(2 * per_language * len(totals)), fit_model)


def language_of(model: LanguageModel | None, text: str | Column) -> Column:
    """struct(lang, score) of a text; `und` with score 0 if it is NULL, has no letter, or nothing was learned."""

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        textops.release()
        langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        data, offsets = textops.byte_column(texts)
        for first, last in _parts(offsets):  # as strings and as numbers only a part at a time
            part = offsets[first : last + 1]
            known = np.array([has_letter(t) for t in texts.slice(first, last - first).to_pylist()], bool)
            if model is not None and known.any():
                best, score = model.predict(features(data[part[0] : part[-1]], part - part[0]))
                langs[first:last] = np.where(known, np.array(model.languages, object)[best], UNKNOWN)
                scores[first:last] = np.where(known, score, 0.0)
        textops.release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return predict(text)


def held_out() -> Column:
    """Rows kept from learning: crc32 of doc_id as text leaves 1 when divided by 3; a NULL doc_id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from the rows that are not held out.

    Repeated rows are predicted alike; extra columns are not read. An empty table gives an empty result.
    """
    found = "_found"
    rows = docs.select("doc_id", held_out().alias("held_out"), language_of(train(docs.where(~held_out())), "text").alias(found))
    return rows.select("doc_id", "held_out", F.col(f"{found}.lang").alias("lang_pred"), F.col(f"{found}.score").alias("score"))
