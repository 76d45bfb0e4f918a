"""Toxicity by cumulative-link ordinal regression on the words of a text.

Severity grades are ordered; P(grade <= k) = logistic(threshold_k - s), with one weighted sum s of the words
present for all thresholds. Weights are sparse (L1). Fitting uses a bounded sample of labelled rows; scoring
reads every whole text and needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.llm import textops
from costweave.llm.shared import fit_in_task

GRADES = 3  # 0 sound, 1 poor (quality 0, not toxic), 2 toxic
SAMPLE_ROWS = 12_000  # labelled rows used for fitting, by least hash of doc_id (twice as many at most)
LEAST_TEXTS = 5  # a word must be in that many sampled texts
LEAST_SIGNAL = 4.0  # standard errors between its shares in the texts above and below a threshold
MOST_WORDS = 2_000
PENALTY = 1e-4  # on weights scaled by the root of the word's share of texts
STEPS = 1500

OTHERS = np.ones(256, dtype=bool)
OTHERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, row), each word once a row."""
    words, row, _, _ = textops.word_hashes(data, offsets, OTHERS)
    order = np.lexsort((words, row))
    words, row = words[order], row[order]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
    return words[new], row[new]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # rising; one fewer than grades

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The weighted sum of the words present in each row."""
        total = np.zeros(len(offsets) - 1)
        if not len(self.words):
            return total
        may = np.zeros(1 << 16, bool)
        may[self.words >> np.uint64(48)] = True
        words, row, _, _ = textops.word_hashes(data, offsets, OTHERS)
        some = may[words >> np.uint64(48)]
        words, row = words[some], row[some]
        index = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        hit = self.words[index] == words
        once = np.unique(row[hit] * len(self.words) + index[hit])
        np.add.at(total, once // len(self.words), self.weights[once % len(self.words)])
        return total

    def exceeds(self, sums: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return 1 - logistic(self.thresholds[None] - sums[:, None])


def fit_ordinal(sample: pd.DataFrame) -> OrdinalModel:
    """From rows (grade from 0 without gaps, words: hashes as bytes): proximal descent with momentum."""
    sample = sample.sort_values(["grade", "words"], kind="stable")
    found, y = np.unique(sample["grade"].to_numpy(), return_inverse=True)
    sets = [np.frombuffer(w, np.uint64) for w in sample["words"]]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    known, place = np.unique(flat, return_inverse=True)
    if len(found) < 2:
        return OrdinalModel(known[:0], np.zeros(0), np.where(np.arange(GRADES - 1) < found[0], -40.0, 40.0))
    texts = np.bincount(place, minlength=len(known))
    share = texts / len(y)
    signal = np.zeros(len(known))
    for k in range(1, len(found)):
        above = y >= k
        ones = np.bincount(place, weights=above[row], minlength=len(known))
        gap = ones / above.sum() - (texts - ones) / (~above).sum()
        error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / above.sum() + 1 / (~above).sum()))
        signal = np.maximum(signal, np.abs(gap) / error)
    signal[(texts < LEAST_TEXTS) | (signal < LEAST_SIGNAL)] = 0
    kept = np.sort(np.argsort(-signal, kind="stable")[:MOST_WORDS][: int((signal > 0).sum())])
    number = np.full(len(known), -1)
    number[kept] = np.arange(len(kept))
    some = number[place] >= 0
    row, column = row[some], number[place][some]

    scale = 1 / np.sqrt(np.maximum(share[kept], 1e-12))  # rare words move as fast as common ones
    shares = np.cumsum(np.bincount(y, minlength=len(found)))[:-1] / len(y)
    thresholds = np.log(shares / (1 - shares))
    weights = np.zeros(len(kept))
    spread = np.ones(len(kept))
    top = 1.0
    for _ in range(30):  # largest eigenvalue of the words' products, for the length of a step
        spread = scale * np.bincount(column, weights=np.bincount(row, weights=(scale * spread)[column], minlength=len(y))[row], minlength=len(kept))
        top = float(np.linalg.norm(spread)) if len(spread) else 1.0
        spread = spread / max(top, 1e-12)
    rate = 1 / (0.3 * max(top, 1.0) / len(y) + 0.25)
    past_w, past_t = weights, thresholds
    for step in range(STEPS):
        push = step / (step + 3)
        w, t = weights + push * (weights - past_w), thresholds + push * (thresholds - past_t)
        sums = np.bincount(row, weights=(scale * w)[column], minlength=len(y))
        edges = np.concatenate([[-40.0], t, [40.0]])
        upper, lower = logistic(edges[y + 1] - sums), logistic(edges[y] - sums)
        mass = np.maximum(upper - lower, 1e-9)
        slope_w = scale * np.bincount(column, weights=(1 - upper - lower)[row], minlength=len(kept)) / len(y)
        slope_t = np.zeros(len(t) + 2)
        np.add.at(slope_t, y + 1, -upper * (1 - upper) / mass)
        np.add.at(slope_t, y, lower * (1 - lower) / mass)
        past_w, past_t = weights, thresholds
        weights = w - rate * slope_w
        weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * PENALTY, 0)
        thresholds = np.maximum.accumulate(t - rate * slope_t[1:-1] / len(y))
    some = weights != 0
    # a grade that the sample lacks has no threshold of its own: it is as unlikely as can be
    full = [-40.0 if found[0] > k else 40.0 if found[-1] <= k else thresholds[np.searchsorted(found, k, side="right") - 1] for k in range(GRADES - 1)]
    return OrdinalModel(known[kept][some], (scale * weights)[some], np.array(full))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel | None:
    """Fit on docs (doc_id, text) with labels (doc_id, quality, toxic); None if nothing is labelled.

    Grades follow from the labels, the worst of a document counts. Rows without toxic label or text say nothing.
    """
    known = labels.select("doc_id", "quality", "toxic").where("doc_id is not null and toxic is not null")
    total = known.count()
    if not total:
        return None
    share = min(1.0, sample_rows / total)
    grade = F.when(F.col("toxic") != 0, GRADES - 1).when(F.col("quality") == 0, 1).otherwise(0)
    chosen = (
        known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        .groupBy("doc_id").agg(F.max(grade).alias("grade")).limit(2 * sample_rows)
    )
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample_rows

    def measure(batches):
        for batch in batches:
            data, offsets = textops.byte_column(pc.utf8_lower(batch.column(0)))
            words, row = words_of(data, offsets)
            cuts = np.searchsorted(row, np.arange(len(offsets)))
            sets = [words[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sets, pa.binary())], names=["grade", "words"])

    sample = rows.select("text", "grade").mapInArrow(measure, "grade int, words binary")
    return fit_in_task(sample, fit_ordinal)


def grade(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, severity (likeliest grade), expected_severity, p_toxic (of the highest grade), toxic (p_toxic >= 0.5) of every row.

    NULL texts have no words and get the grades of a text without any; with no labels at all everything is 0.
    Repeated rows are graded alike; columns beyond doc_id and text are not read.
    """
    model = train(docs, labels, sample_rows) or OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 40.0))
    names = ["doc_id", "severity", "expected_severity", "p_toxic", "toxic"]

    def score(batches):
        for batch in batches:
            data, offsets = textops.byte_column(pc.utf8_lower(batch.column(1)))
            sums = np.concatenate([
                model.sums(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in textops.blocks(offsets)
            ] or [np.zeros(0)])
            above = model.exceeds(sums)
            exact = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(exact.argmax(axis=1).astype(np.int32)), pa.array(above.sum(axis=1)),
                pa.array(above[:, -1]), pa.array(above[:, -1] >= 0.5),
            ], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {kind}, severity int, expected_severity double, p_toxic double, toxic boolean"
    )
