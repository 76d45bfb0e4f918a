"""Ranked lexical search with sequential reads (NRA) over impact-sorted lists.

The documents of a task are dealt into shards of bounded size. A shard's index has one list a query term, the
documents with the greatest impact first. An item reads its lists from the front, in steps that double, and
keeps for every document seen a lower bound (impacts read) and an upper one (plus, for each list in which it
was not seen, the last impact read there). Documents that cannot reach the best k any more go; reading ends
when the k best are certain and their bounds meet. The best of all shards are the best of all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.session import reuse

BLOCK_BYTES = 1 << 21  # item texts searched for at once: bounds what a task is sent
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 4_000_000
FIRST_READ = 64
_LETTERS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Letters, digits and everything beyond ASCII in maximal runs, A-Z in lower case; bytes of UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_LETTERS).split()


def weight_of(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


class Shard:
    """Impact-sorted lists of some documents: for each term their places and impacts, the greatest first."""

    def __init__(self, terms: np.ndarray, places: np.ndarray, scores: np.ndarray, size: int, n_terms: int, order: np.ndarray):
        by = np.lexsort((-scores, terms))
        self.places, self.scores = places[by], scores[by]
        self.bounds = np.searchsorted(terms[by], np.arange(n_terms + 1))
        self.size, self.order = size, order  # order: rank of a place by ascending doc_id

    def best(self, item: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best of an item [(term, weight times its repeats)], the best first."""
        lists = [
            (self.places[self.bounds[t] : self.bounds[t + 1]], self.scores[self.bounds[t] : self.bounds[t + 1]], w)
            for t, w in item if self.bounds[t] < self.bounds[t + 1]
        ]
        empty = np.zeros(0, np.int64)
        if not lists:
            return empty, empty
        lower = np.zeros(self.size, np.int64)
        seen = np.zeros((len(lists), self.size), bool)
        last = np.zeros(len(lists), np.int64)
        held: np.ndarray | None = None  # documents that may still be among the best, once no other can join them
        done, upto = 0, FIRST_READ
        while True:
            for number, (places, scores, weight) in enumerate(lists):
                here, impacts = places[done:upto], scores[done:upto] * weight
                if len(here):
                    if held is not None:
                        wanted = member[here]
                        here, impacts = here[wanted], impacts[wanted]
                    lower[here] += impacts
                    seen[number, here] = True
                last[number] = scores[upto - 1] * weight if upto < len(scores) else 0
            found = np.flatnonzero(seen.any(axis=0)) if held is None else held
            low = lower[found]
            high = low + last.sum() - last @ seen[:, found]
            order = self.order[found]
            if len(found) > k:
                edge = np.partition(low, -k)[-k]
                level = np.flatnonzero(low == edge)
                tie = np.sort(order[level])[k - int((low > edge).sum()) - 1]
                alive = (high > edge) | ((high == edge) & (order <= tie))
                closed = last.sum() < edge
            else:
                alive, closed = np.ones(len(found), bool), not last.any()
            if closed:
                held = found[alive]
                member = np.zeros(self.size, bool)
                member[held] = True
                if len(held) <= k and (low[alive] == high[alive]).all():
                    by = np.lexsort((self.order[held], -lower[held]))
                    return held[by], lower[held][by]
            done, upto = upto, upto * 2


def _blocks(rows: Iterable, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, list[bytes]]]]:
    block, size = [], 0
    for row in rows:
        terms = terms_of(row["text"])
        block.append((row["number"], terms))
        size += sum(map(len, terms)) + len(terms)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _statistics(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all their terms, and how many documents hold each term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs_, words = Counter(), 0, 0
        for batch in batches:
            for text in batch.column(1):
                terms = terms_of(text.as_py())
                docs_ += bool(terms)
                words += len(terms)
                held.update(vocabulary.keys() & set(terms))
        keys = [-2, -1, *(vocabulary[t] for t in held)]
        yield pa.RecordBatch.from_pydict(
            {"term": pa.array(keys, pa.int64()), "n": pa.array([docs_, words, *held.values()], pa.int64())}
        )

    rows = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found.pop(-2, 0), found.pop(-1, 0), found


def _search_block(docs: DataFrame, block: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """number, doc_id, score of the best k of every shard for each item of the block."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    n_docs, n_words, holding = _statistics(docs, vocabulary)
    weights = {i: weight_of(n_docs, df) for i, df in holding.items()}
    items = [
        (number, [(t, weights[t] * times) for t, times in Counter(vocabulary[t] for t in terms).items() if weights.get(t)])
        for number, terms in block
    ]
    used = {t: i for t, i in vocabulary.items() if weights.get(i)}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, sizes, terms_in, counts, lengths = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            places = np.repeat(np.arange(len(doc_ids)), sizes)
            tf = np.array(counts, np.int64)
            length_part = 25 + (75 * np.array(lengths, np.int64) * n_docs) // n_words
            scores = (1_000_000_000 * tf) // (1000 * tf + 8 * length_part[places])
            missing = np.array([i is None for i in doc_ids])
            order = np.empty(len(doc_ids), np.int64)
            order[np.lexsort((np.array([i or 0 for i in doc_ids], np.int64), missing))] = np.arange(len(doc_ids))
            shard = Shard(np.array(terms_in, np.int64), places, scores, len(doc_ids), len(vocabulary), order)
            numbers, found, points = [], [], []
            for number, item in items:
                best, score = shard.best(item, k)
                numbers += [number] * len(best)
                found += [doc_ids[p] for p in best.tolist()]
                points += score.tolist()
            for held in (doc_ids, sizes, terms_in, counts, lengths):
                held.clear()
            return pa.RecordBatch.from_pydict({
                "number": pa.array(numbers, pa.int64()), "doc_id": pa.array(found, pa.int64()), "score": pa.array(points, pa.int64()),
            })

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms = terms_of(text.as_py())
                tf = Counter(terms)
                mine = used.keys() & tf.keys()
                if not mine:
                    continue
                doc_ids.append(doc_id)
                lengths.append(len(terms))
                sizes.append(len(mine))
                terms_in += [used[t] for t in mine]
                counts += [tf[t] for t in mine]
                if len(doc_ids) >= SHARD_DOCS or len(terms_in) >= SHARD_POSTINGS:
                    yield flush()
        if doc_ids:
            yield flush()

    return docs.mapInArrow(search, "number long, doc_id long, score long")


def search(items: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long): the k best documents of every item, scores above 0 only.

    Needs item_id and text, doc_id and text; other columns take no part, whatever their names. Equal scores go
    by ascending doc_id, NULL last. Every row counts: repeated documents each take a rank, repeated items each
    get an answer. A NULL or empty text has no terms: such a document is in no answer and not among the counted,
    such an item has no answer; an empty table gives none.

    Texts are read whole, twice a block of items (2 MB of terms). Neither postings nor intervals are shuffled,
    only k rows a shard and item. Items reach the driver one block at a time.
    """
    spark = items.sparkSession
    numbered = reuse(items.select("item_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("number")))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = spark.createDataFrame([], "number long, doc_id long, score long")
    for block in _blocks(numbered.select("number", "text").toLocalIterator()):
        parts = parts.unionByName(reuse(_search_block(slim, block, k)))
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = parts.withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(numbered.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
