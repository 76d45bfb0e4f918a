"""Periodic runs of words in whole texts, by an enhanced suffix array and its branching tandem repeats.

The suffixes of many texts are ranked together, words of different texts being different letters. An LCP
interval of depth d holds the suffixes that share d words. For every suffix i of its children but the largest,
i + d or i - d in the interval, but in another child, makes a square of period d that the next word ends. Its
rotations to the left are the other squares of the run, which ends where the square does. There are no tree
nodes: intervals are the nearest smaller values of the LCP array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 1 << 18  # words ranked at once: bounds a task's memory; a longer text stands alone
LEAST, TIMES = 24, 3  # a run has at least LEAST words and TIMES periods


# ---- suffix array ----------------------------------------------------------

def rank_levels(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all positions by their first 1, 2, 4, ... symbols; equal ranks stand for equal stretches.

    The last ranks are distinct. Only positions that still share a rank are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    opens = np.concatenate([[True], symbols[order[1:]] != symbols[order[:-1]]])
    starts = np.flatnonzero(opens)
    rank = np.empty(n, np.int64)
    rank[order] = starts[np.cumsum(opens) - 1]
    sizes = np.diff(np.append(starts, n))
    levels, open_, h = [rank], order[np.repeat(sizes > 1, sizes)], 1
    while len(open_):
        after = np.where(open_ + h < n, rank[np.minimum(open_ + h, n - 1)] + 1, 0)
        keys = rank[open_] * (n + 1) + after
        by = np.argsort(keys, kind="stable")
        open_, keys = open_[by], keys[by]
        old = rank[open_]
        at = np.arange(len(open_))
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        group = np.concatenate([[True], old[1:] != old[:-1]])
        first = np.maximum.accumulate(np.where(fresh, at, 0))
        origin = np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[open_] = old + first - origin
        levels.append(rank)
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(open_)))
        open_ = open_[np.repeat(sizes > 1, sizes)]
        h *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], suffixes: np.ndarray) -> np.ndarray:
    """lcp[r]: symbols that the suffixes r - 1 and r in order share; 0 at both ends."""
    n = len(suffixes)
    lcp = np.zeros(n + 1, np.int64)
    near = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]]) + 1
    a, b = suffixes[near - 1], suffixes[near]
    for k in reversed(range(len(levels) - 1)):
        both = np.maximum(a, b) < n
        same = both & (levels[k][np.where(both, a, 0)] == levels[k][np.where(both, b, 0)])
        step = same.astype(np.int64) << k
        a, b = a + step, b + step
        lcp[near] += step
    return lcp


def _nearest_smaller(values: np.ndarray, wanted: np.ndarray, step: int) -> np.ndarray:
    """For each wanted place the nearest place to the left (step -1) or right (1) with a smaller value."""
    found = np.arange(len(values)) + step
    open_ = wanted[values[found[wanted]] >= values[wanted]]
    while len(open_) > 32:
        found[open_] = found[found[open_]]
        open_ = open_[values[found[open_]] >= values[open_]]
    for place in open_.tolist() if step < 0 else open_.tolist()[::-1]:  # the last few one by one
        at, value = int(found[place]), values[place]
        while values[at] >= value:
            at = int(found[at])
        found[place] = at
    return found[wanted]


def branching_squares(suffixes: np.ndarray, rank: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square whose next symbol breaks its period, by period."""
    n = len(suffixes)
    none = np.zeros(0, np.int64)
    cuts = np.flatnonzero(lcp > 0)
    if not len(cuts):
        return none, none
    low, high = _nearest_smaller(lcp, cuts, -1), _nearest_smaller(lcp, cuts, 1)
    # cuts of one interval side by side; a child opens at the interval's start and at each of its cuts
    by = np.lexsort((cuts, high, low))
    cuts, low, high = cuts[by], low[by], high[by]
    first = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    last = np.append(first[1:], True)
    number = np.cumsum(first) - 1
    child_low = np.concatenate([low[first], cuts])
    child_high = np.concatenate([cuts[first], np.where(last, high, np.append(cuts[1:], 0))])
    interval = np.concatenate([np.arange(number[-1] + 1), number])
    size = child_high - child_low
    by = np.lexsort((-size, interval))
    small = by[np.concatenate([[False], interval[by][1:] == interval[by][:-1]])]  # all but one largest
    child_low, child_high, interval, size = child_low[small], child_high[small], interval[small], size[small]
    depth = lcp[cuts[first]][interval]
    low, high = low[first][interval], high[first][interval]
    item = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(item)) - np.repeat(np.cumsum(size) - size, size) + child_low[item]
    here, depth_of = suffixes[place], depth[item]
    starts, periods = [], []
    for sign in (1, -1):
        other = here + sign * depth_of
        valid = (other >= 0) & (other < n)
        at = rank[np.where(valid, other, 0)]
        valid &= (at >= low[item]) & (at < high[item]) & ((at < child_low[item]) | (at >= child_high[item]))
        starts.append(here[valid] if sign > 0 else other[valid])
        periods.append(depth_of[valid])
    pairs = np.unique(np.stack([np.concatenate(periods), np.concatenate(starts)]), axis=1)
    return pairs[1], pairs[0]


def _rotations(symbols: np.ndarray, start: int, period: int) -> int:
    """The first start of the squares that the square at `start` rotates to on the left."""
    width = 64
    while start:
        low = max(0, start - width)
        breaks = np.flatnonzero(symbols[low:start] != symbols[low + period : start + period])
        if len(breaks):
            return low + int(breaks[-1]) + 1
        start, width = low, width * 2
    return 0


def find_runs(symbols: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal stretch with smallest period q and length >= max(least, times * q).

    `times` is 3 or more; by start, then period.
    """
    if len(symbols) < least:
        return []
    levels = rank_levels(symbols)
    rank = levels[-1]
    suffixes = np.empty(len(rank), np.int64)
    suffixes[rank] = np.arange(len(rank))
    starts, periods = branching_squares(suffixes, rank, common_prefixes(levels, suffixes))
    # a run needs so many rotations: all squares step left together until few are left
    needed = np.maximum(least, times * periods) - 2 * periods
    for step in range(1, 9):
        before = starts - step
        on = (needed < step) | ((before >= 0) & (symbols[np.maximum(before, 0)] == symbols[np.maximum(before, 0) + periods]))
        starts, periods, needed = starts[on], periods[on], needed[on]
    found: dict[int, list[tuple[int, int]]] = {}
    for start, period in zip(starts.tolist(), periods.tolist()):  # shorter periods first
        end = start + 2 * period
        if any(first <= start for first, _ in found.get(end, ())):
            continue  # inside a run of a shorter period: a multiple of it
        first = _rotations(symbols, start, period)
        if end - first >= max(least, times * period):
            found.setdefault(end, []).append((first, period))
    return sorted((first, end - first, period) for end, runs in found.items() for first, period in runs)


# ---- Spark -----------------------------------------------------------------

def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, runs (array of start, length, period; by start, then period) and collapsed (string).

    Words are the stretches between blanks (\\x20, \\x09 to \\x0D); runs are counted in them from 0. A word stays
    in `collapsed` unless some run holds it after that run's first period; kept words are joined by one space.
    Needs doc_id and text; other columns take no part, whatever their names. One row a row, repeated rows alike,
    NULL doc_id stays NULL; NULL, empty and short texts have no run. Texts are never cut; no shuffle.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(doc_ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        known: dict[bytes, int] = {}
        sizes = np.array([len(t) for t in texts], np.int64)
        letters = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(sizes.sum()))
        letters += np.repeat(np.arange(len(texts)), sizes) * (len(known) + 1)
        ends = np.cumsum(sizes)
        runs: list[list] = [[] for _ in texts]
        kept = None
        for start, length, period in find_runs(letters, least, times):
            if kept is None:
                kept = np.ones(len(letters), bool)
            row = int(np.searchsorted(ends, start, side="right"))
            runs[row].append({"start": start - int(ends[row] - sizes[row]), "length": length, "period": period})
            kept[start + period : start + length] = False
        for row, found in enumerate(runs):
            if found:
                mask = kept[ends[row] - sizes[row] : ends[row]].tolist()
                texts[row] = [w for w, stays in zip(texts[row], mask) if stays]
        collapsed = [b" ".join(t).decode("utf-8", "replace") for t in texts]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, kind), pa.array(runs, pa.list_(run_type)), pa.array(collapsed, pa.string())],
            names=["doc_id", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = (text.as_py() or "").encode().split()  # bytes split at exactly these blanks
                if texts and size + len(words) > BLOCK_WORDS:
                    yield work(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
                doc_ids.append(doc_id.as_py())
                texts.append(words)
                size += len(words)
        if texts:
            yield work(doc_ids, texts)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = pa.int64()
    return slim.mapInArrow(
        run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the rows, by crc32 of the decimal doc_id, are made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = docs.select(
        "doc_id", "text", h.alias("_h"), g.alias("_g"),
        F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"))).alias("_words"),
    ).withColumn("_n", F.coalesce(F.size("_words"), F.lit(0)))
    shift = F.pmod("_g", F.greatest("_n", F.lit(1)))
    numbered = words.withColumns({
        "_a": shift.cast("int"), "_p": (F.lit(1) + F.floor((F.col("_n") - shift) / (F.lit(3) + F.col("_g") % 8))).cast("int"),
    })
    part = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    copies = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    periodic = F.slice(F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.flatten(F.array_repeat(part, copies))), F.lit(1), F.col("_n"))
    return numbered.select("doc_id", F.when(F.col("_n") > 0, F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def _best(runs: Column) -> Column:
    """The run with the greatest length / period, the first of equals; NULL where there is none."""
    better = lambda best, run: F.when(
        best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run
    ).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of `collapse_runs`."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = collapse_runs(docs).withColumn("best", _best(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
