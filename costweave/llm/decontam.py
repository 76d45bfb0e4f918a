"""Benchmark decontamination: rare n-gram seeds join texts to benchmark items, local alignment scores the pair.

Words are runs of letters and digits in lower case. A pair of neighbouring words of an item is a seed; a text hits it
where the two words are neighbours or have one word between them. An alignment (Smith-Waterman: match 2, mismatch and
gap -1) of the least score cannot avoid a number of hits that follows from the item's length (`least_hits`), so half
of that number of an item's pairs, those that most items share, are left out, and a place is looked at when it has
the other half of the hits on diagonals as near to each other as the score allows. No alignment of the least score
is lost, however the words are edited. Items of up to three words must be there whole to be looked at.
Around the seeds on a text the words are aligned with the item, as far out as an alignment of the least score can
reach; the score is the share of the item's best possible value.
Items are taken in blocks of bounded size, each block against all texts; texts are never shuffled or cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave.llm import textops

WHOLE_WORDS = 3  # items of so many words are seeds as a whole
LEAST_SCORE = 0.5
BLOCK_WORDS = 1_000_000  # item words held by a task at once
HITS = 2_000_000  # seeds on texts held by a task at once; one text is not cut
MATCHES = "array<struct<item_id:long,score:double,first_word:long,last_word:long>>"
MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

OTHERS = np.ones(256, dtype=bool)
OTHERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def least_value(length: int, least_score: float) -> int:
    """Least alignment value of an item of `length` words that is worth `least_score`."""
    return max(1, int(np.ceil(2 * length * least_score - 1e-9)))


def least_hits(length: int, value: int) -> int:
    """Pairs of neighbouring item words that every alignment of that value matches as neighbours or with one word between.

    With k words matched, the k - 1 steps from one to the next are such pairs unless they skip item words (one of the
    length - k that are left, at a cost of 1 or more) or two words of the text or more (at a cost of 2 or more). All
    of them cost 2 * k - value at most.
    """
    least = length
    for k in range(-(-value // 2), length + 1):
        cost = 2 * k - value
        skips = min(length - k, cost)
        least = min(least, k - 1 - skips - (cost - skips) // 2)
    return least


class GramLookup:
    """Finds known n-grams among the words of many rows; pairs also with one word between."""

    def __init__(self, grams: dict[tuple[int, bool], np.ndarray]):
        """grams: sorted distinct hashes by (number of words, whether they may stand apart)."""
        self.grams = {kind: g for kind, g in grams.items() if len(g)}
        self.may = {}
        for kind, known in self.grams.items():
            self.may[kind] = np.zeros(1 << 22, bool)
            self.may[kind][known >> np.uint64(42)] = True

    def find(self, words: np.ndarray, row: np.ndarray):
        """(kind, index of the gram, first word) of every occurrence that stays in its row, by first word."""
        for (n, apart), known in self.grams.items():
            hashes = textops.gram_hashes(words, n)
            yield (n, apart), *self._known((n, apart), hashes, row, n)
            if apart and len(words) > 2:
                yield (n, apart), *self._known((n, apart), textops.pair_hashes(words[:-2], words[2:]), row, 3)

    def _known(self, kind, hashes, row, span):
        known = self.grams[kind]
        at = np.flatnonzero(self.may[kind][hashes >> np.uint64(42)])
        at = at[row[at] == row[at + span - 1]]
        index = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        hit = known[index] == hashes[at]
        return index[hit], at[hit]


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(best local alignment value, end of it in words); match 2, mismatch and gap -1."""
    steps = np.arange(1, len(words) + 1)
    above = np.zeros(len(words) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        here = np.maximum(np.maximum(above[:-1] + np.where(words == word, 2, -1), above[1:] - 1), 0)
        here = np.maximum.accumulate(here + steps) - steps
        top = int(here.argmax())
        if here[top] > best:
            best, end = int(here[top]), top + 1
        above = np.concatenate([[0], here])
    return best, end


class ItemBlock:
    """Benchmark items with their seeds; pickled to the tasks."""

    def __init__(self, item_ids: list, texts: list[str], least_score: float = LEAST_SCORE):
        self.least_score = least_score
        data = [t.encode() for t in pc.utf8_lower(pa.array(texts, pa.string())).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        words, row, _, _ = textops.word_hashes(np.frombuffer(b"".join(data), np.uint8), offsets, OTHERS)
        cuts = np.searchsorted(row, np.arange(len(data) + 1))
        self.item_ids = item_ids
        self.items = [words[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

        self._set_seeds()

    def _set_seeds(self) -> None:
        """The pairs of every item but its commonest, with their places; how many hits a place must have, how near."""
        pairs = [textops.gram_hashes(item, 2) for item in self.items]
        long = [len(item) > WHOLE_WORDS for item in self.items]
        every, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *(p for p, ok in zip(pairs, long) if ok)]), return_counts=True)
        seeds: dict[tuple[int, bool], list] = {}
        self.need, self.reach = np.ones(len(self.items), np.int64), np.zeros(len(self.items), np.int64)
        for number, (item, own) in enumerate(zip(self.items, pairs)):
            if not long[number]:
                if len(item):
                    found = (textops.gram_hashes(item, len(item)), np.array([number]), np.array([0]))
                    seeds.setdefault((len(item), False), []).append(found)
                continue
            value = least_value(len(item), self.least_score)
            hits = max(1, least_hits(len(item), value))
            common = hits // 2
            self.need[number], self.reach[number] = hits - common, 2 * len(item) - value
            rare = np.sort(np.argsort(times[np.searchsorted(every, own)], kind="stable")[: len(own) - common])
            seeds.setdefault((2, True), []).append((own[rare], np.full(len(rare), number), rare))
        self.places = {}
        known = {}
        for kind, found in seeds.items():
            hashes, item, place = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(hashes, kind="stable")
            known[kind], first = np.unique(hashes[order], return_index=True)
            self.places[kind] = (np.append(first, len(hashes)), item[order], place[order])
        self.lookup = GramLookup(known)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
        """For every row the items found in it, best place each, by item."""
        words, row, _, _ = textops.word_hashes(data, offsets, OTHERS)
        out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        edges = np.searchsorted(row, np.arange(len(offsets)))
        found = [(n, index, at, np.diff(self.places[n][0])[index]) for n, index, at in self.lookup.find(words, row)]
        load = sum(np.bincount(row[at], counts, len(out)) for _, _, at, counts in found) if found else np.zeros(len(out))
        for first, last in textops.blocks(np.concatenate([[0], np.cumsum(load)]), HITS):
            hits = []
            for n, index, at, counts in found:
                a, b = np.searchsorted(at, edges[[first, last]])
                starts, item, place = self.places[n]
                counts = counts[a:b]
                slot = np.repeat(starts[index[a:b]], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                where = np.repeat(at[a:b], counts)
                hits.append((row[where], item[slot], where - place[slot]))
            self._score(words, edges, hits, out)
        return out

    def _score(self, words: np.ndarray, edges: np.ndarray, hits: list[tuple], out: list[list[dict]]) -> None:
        """Align the items around their hits (row, item, first word if nothing is left out) and add what is found to out."""
        if not sum(len(h[0]) for h in hits):
            return
        rows, items, starts = (np.concatenate(x) for x in zip(*hits))
        order = np.lexsort((starts, items, rows))
        rows, items, starts = rows[order], items[order], starts[order]
        near = self._enough(rows, items, starts)
        rows, items, starts = rows[near], items[near], starts[near]
        if not len(rows):
            return
        length = np.array([len(i) for i in self.items])[items]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (items[1:] != items[:-1]) | (starts[1:] - starts[:-1] > length[1:] // 2 + 4)
        cuts = np.append(np.flatnonzero(new), len(rows))
        least_score = self.least_score
        best: dict[tuple[int, int], tuple] = {}
        for a, b in zip(cuts[:-1], cuts[1:]):
            r, number = int(rows[a]), int(items[a])
            item = self.items[number]
            slack = int(2 * len(item) * (1 - least_score)) + 1  # more gaps cost too much
            low = max(int(starts[a]) - slack, int(edges[r]))
            high = min(int(starts[b - 1]) + len(item) + slack, int(edges[r + 1]))
            near = words[low:high]
            # matched words bound the value: each is worth 2
            if min(np.isin(item, near).sum(), np.isin(near, item).sum()) < least_score * len(item):
                continue
            value, end = align(item, near)
            score = value / (2 * len(item))
            if score >= least_score and score > best.get((r, number), (0,))[0]:
                _, back = align(item[::-1], near[:end][::-1])
                best[r, number] = (score, low + end - back - int(edges[r]), low + end - 1 - int(edges[r]))
        for (r, number), (score, first_word, last_word) in sorted(best.items()):
            out[r].append({"item_id": self.item_ids[number], "score": score, "first_word": first_word, "last_word": last_word})

    def _enough(self, rows: np.ndarray, items: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which of the sorted hits stand among as many as their item needs, on diagonals within its reach."""
        need = self.need[items]
        first = np.arange(len(rows))
        last = first + need - 1
        end = np.minimum(last, len(rows) - 1)
        ok = (last < len(rows)) & (rows[end] == rows) & (items[end] == items) & (starts[end] - starts <= self.reach[items])
        depth = np.zeros(len(rows) + 1, np.int64)
        np.add.at(depth, first[ok], 1)
        np.add.at(depth, last[ok] + 1, -1)
        return np.cumsum(depth)[:-1] > 0


def item_blocks(benchmark: DataFrame, least_score: float, block_words: int = BLOCK_WORDS) -> list[ItemBlock]:
    """The items (item_id, text) in blocks of about block_words words."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    blocks = []
    number = max(1, -(-total // block_words))
    for k in range(number):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k).distinct().collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        block = ItemBlock([r["item_id"] for r in rows], [r["text"] for r in rows], least_score)
        if any(len(i) for i in block.items):
            blocks.append(block)
    return blocks


def matches_of(blocks: list[ItemBlock], text: str) -> Column:
    """array of (item_id, score, first_word, last_word) for a text column; empty for NULL texts."""

    def column(block):
        @F.arrow_udf(MATCHES)
        def find(texts: pa.Array) -> pa.Array:
            textops.release()
            data, offsets = textops.byte_column(pc.utf8_lower(texts))
            out = []
            for first, last in textops.blocks(offsets):
                part = offsets[first : last + 1]
                out += block.matches(data[part[0] : part[-1]], part - part[0])
            return pa.array(out, MATCH_TYPE)

        return find(text)

    return F.concat(*map(column, blocks)) if blocks else F.array().cast(MATCHES)


def contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word for every text and item with an alignment of least_score or more.

    One row a pair, the best place (the first of equals); repeated documents or items each have their rows.
    Items of up to three words are found only where all their words stand in a row.
    NULL or empty texts and items match nothing. Columns beyond ids and texts are not read.
    """
    blocks = item_blocks(benchmark, least_score)
    return docs.select("doc_id", F.explode(matches_of(blocks, "text")).alias("m")).select("doc_id", "m.*")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs without the rows whose text matches an item."""
    return docs.where(F.size(matches_of(item_blocks(benchmark, least_score), "text")) == 0)
