"""Packing of token sequences by cutting-stock column generation.

Documents are cut every `capacity` ids, and their ends once more at a multiple of a quarter of it. The
histogram of the lengths, in classes of `grain` ids rounded up, is bounded whatever the number of documents.
On it (in one task) a linear program picks patterns (how many pieces of each class share a sequence); new patterns are
priced by a knapsack over the classes. Patterns are taken the rounded-down number of times, the few pieces
left over go first-fit in falling size, and every slot of every pattern is given to the piece of that rank in
its class. Only the patterns pass through the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.llm import textops
from costweave.llm.shared import fit_in_task
from costweave.llm.tokens import ENCODED_BYTES, REMEMBERED_WORDS, encoder_for, vocabulary_path
from costweave.session import reuse

CAPACITY = 2048
GRAIN = 8
END_ID = 1
ROUNDS = 600  # columns at most; a stop before the optimum costs padding only
RANK_ROWS = 50_000  # pieces ranked together in one task


def best_pattern(prices: np.ndarray, units: int) -> np.ndarray:
    """Unbounded knapsack: counts of each class (class c takes c units, index 0 unused) with the highest price."""
    top = len(prices) - 1
    value, taken = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    for room in range(1, units + 1):
        sizes = np.arange(1, min(room, top) + 1)
        gains = value[room - sizes] + prices[sizes]
        at = int(gains.argmax())
        if gains[at] > value[room - 1] + 1e-12:
            value[room], taken[room] = gains[at], sizes[at]
        else:
            value[room] = value[room - 1]
    counts, room = np.zeros(top + 1, np.int64), units
    while room > 0:
        if taken[room]:
            counts[taken[room]] += 1
            room -= taken[room]
        else:
            room -= 1
    return counts


def first_fit(demand: np.ndarray, units: int) -> list[tuple[np.ndarray, int]]:
    """First-fit in falling size on counts: (pattern, times)."""
    left, out = demand.astype(np.int64).copy(), []
    while left.any():
        pattern, room = np.zeros_like(left), units
        for size in range(len(left) - 1, 0, -1):
            fits = min(int(left[size]), room // size)
            pattern[size] += fits
            room -= fits * size
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, times))
        left -= pattern * times
    return out


def solve(demand: np.ndarray, units: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that cover demand[c] pieces of each class c exactly, in few sequences of `units`.

    A revised simplex over the classes with demand. It starts from one pattern a class, each filled with that
    class alone; the duals price the classes for the knapsack, and a pattern worth more than one sequence enters.
    """
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    need = demand[classes].astype(float)
    basis = np.diag((units // classes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    amounts = inverse @ need
    for step in range(rounds):
        duals = inverse.sum(axis=0)  # every pattern costs one sequence
        prices = np.zeros(units + 1)
        prices[classes] = np.maximum(duals, 0)
        column = best_pattern(prices, units)[classes].astype(float)
        if column @ duals <= 1 + 1e-6:
            break
        direction = inverse @ column
        rising = direction > 1e-9
        if not rising.any():
            break
        ratios = np.full(len(classes), np.inf)
        ratios[rising] = amounts[rising] / direction[rising]
        leaves = int(ratios.argmin())
        basis[:, leaves] = column
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[leaves] / direction[leaves]
            inverse = inverse - np.outer(direction, row)
            inverse[leaves] = row
        amounts = np.maximum(inverse @ need, 0)
    left, out = demand.astype(np.int64).copy(), []
    for at, times in enumerate(np.floor(amounts + 1e-9).astype(np.int64)):
        pattern = np.zeros_like(left)
        pattern[classes] = np.rint(basis[:, at]).astype(np.int64)
        times = min(int(times), int((left[pattern > 0] // pattern[pattern > 0]).min()))
        if times > 0:
            out.append((pattern, times))
            left -= pattern * times
    return out + first_fit(left, units)


def pieces_of(
    docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, remembered: int = REMEMBERED_WORDS
) -> DataFrame:
    """Pieces of every document (doc_id, text): row, doc_id, start, length, ids_crc32, doc_tokens.

    A document is its ids and the end id, cut every `capacity` ids, and once more so that what is left splits
    into a multiple of a quarter and less than a quarter: the small pieces fill sequences that the large ones
    cannot. A NULL text is empty. No shuffle. `remembered` bounds the words a worker process keeps the ids of.
    """
    path, step = path or vocabulary_path(), capacity // 4
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_for(path, remembered), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            textops.release()
            _, offsets = textops.byte_column(batch.column(1))
            for first, last in textops.blocks(offsets, ENCODED_BYTES):
                rows, texts = [], batch.column(1).slice(first, last - first)
                for doc_id, ids in zip(batch.column(0).slice(first, last - first).to_pylist(), encoder.encode(texts)):
                    ids += end
                    total = len(ids) // 4
                    cuts = [*range(0, total, capacity), total]
                    if (total - cuts[-2]) % step and total - cuts[-2] > step:
                        cuts.insert(-1, total - (total - cuts[-2]) % step)
                    for start, stop in zip(cuts, cuts[1:]):
                        rows.append((doc_id, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop]), total))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)
        textops.release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, ", ".join(f"{n} long" for n in names))


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """pieces (keys, length from 1 to capacity) with sequence_id and offset; sequences hold at most `capacity`.

    Sequences are numbered from 0 without gaps. Pieces with equal keys and length are interchangeable; extra
    columns stay. An empty table gives an empty result.
    """
    spark, units = pieces.sparkSession, -(-capacity // grain)
    if capacity % grain:
        raise ValueError("grain must divide capacity")
    stored = reuse(pieces.withColumn("_class", F.ceil(F.col("length") / F.lit(grain)).cast("int")))

    def plan_of(histogram):
        demand = np.zeros(units + 1, np.int64)
        demand[histogram["_class"]] = histogram["n"]
        return demand, solve(demand, units)

    demand, patterns = fit_in_task(stored.groupBy("_class").agg(F.count("*").alias("n")), plan_of) or (np.zeros(1), [])
    slots, base, given = [], 0, np.zeros(units + 1, np.int64)
    for pattern, times in patterns:
        for size in np.flatnonzero(pattern):
            each = int(pattern[size])
            slots.append((int(size), int(given[size]), int(given[size] + each * times), each, base))
            given[size] += each * times
        base += times
    # a rank in each class without a class ever meeting in one task: rank in a bucket, after the buckets before
    buckets = max(1, -(-int(demand.sum()) // RANK_ROWS))
    spread = stored.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sizes = spread.groupBy("_class", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_class", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_class", "_bucket").orderBy(*keys, "length")
    ranked = spread.withColumn("_rank", F.row_number().over(own) - 1).join(sizes, ["_class", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    types = {"_size": pa.int32(), "_low": pa.int64(), "_high": pa.int64(), "_each": pa.int64(), "_base": pa.int64()}
    columns = list(zip(*slots)) or [()] * len(types)
    # as an Arrow table: rows of a Python list would start a second set of Python processes on every executor
    plan = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types)))
    placed = ranked.join(
        F.broadcast(plan),  # at most classes squared rows, whatever the number of pieces
        (F.col("_class") == F.col("_size")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high")),
    ).withColumn("sequence_id", F.col("_base") + F.expr("(_rank - _low) div _each"))
    inside = Window.partitionBy("sequence_id").orderBy(*keys, "_rank", "_class").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **how) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs (doc_id, text)."""
    return pack(pieces_of(docs, capacity, **how), ["doc_id", "start", "ids_crc32"], capacity)
