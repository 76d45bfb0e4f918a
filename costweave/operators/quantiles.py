"""Exact interpolated quantiles per group, also for groups too large for one task.

Spark's `percentile` keeps all distinct values of a group in one task. That is the plan for tables up
to DIRECT_ROWS rows. Larger tables are first narrowed: a mergeable sketch brackets each wanted order
statistic, one scan counts what lies below and keeps only the values inside the bracket (about
4/accuracy of the group), and the wanted ranks are read off those. Nothing is approximate in the end:
a bracket that does not hold its rank is widened and tried again.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from costweave.operators.lookup import attach
from costweave.session import reuse

DIRECT_ROWS = 1_000_000
SKETCH_ACCURACY = 10_000
MANY = 16  # quantiles of a column of one group, from which its brackets are searched instead of tried one by one
SLOTS = 1024  # parts of a bracket that are summed up before one of them is sorted


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    also: Mapping[str, Column] | None = None,
    direct_rows: int = DIRECT_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """One row per group: `by` columns, then per entry alias -> (value column, probability).

    NULL values are ignored; a group without values has NULL. NULL groups are kept as a group.
    `also` are further aggregates of df, taken in the same pass. df is read at least twice: pass a
    stored table or something cheap on top of one.
    """
    also = dict(also or {})
    by = list(by)
    columns = sorted({column for column, _ in wanted.values()})
    probabilities = {c: sorted({p for column, p in wanted.values() if column == c}) for c in columns}
    rows = df.count()
    if rows <= direct_rows:
        # one value map per column, however many of its quantiles are wanted
        found = df.groupBy(*by).agg(
            *[F.percentile(c, F.array(*[F.lit(p) for p in probabilities[c]])).alias(f"_q_{c}") for c in columns],
            *[value.alias(alias) for alias, value in also.items()],
        )
        return found.select(*by, *[
            F.element_at(f"_q_{c}", probabilities[c].index(p) + 1).alias(alias) for alias, (c, p) in wanted.items()
        ], *also)
    # a finer sketch for larger tables keeps what is left in a bracket at a few million rows
    accuracy = max(accuracy, min(rows // 1_000_000, 2**31 - 1))
    quantiles = _narrowed_quantiles(df.select(*by, *columns), by, wanted, probabilities, accuracy)
    if not also:
        return quantiles
    sums = df.groupBy(*by).agg(*[value.alias(alias) for alias, value in also.items()])
    return _join_groups(quantiles, sums, by)


def _join_groups(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Join two results that have one row per group (NULL groups match)."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(right, same, "inner").drop(*[f"_r_{c}" for c in by])


def _bracketed(values: DataFrame, brackets: DataFrame) -> DataFrame:
    """(_g, _c, _p, _rank, _lo, _hi, _v, _k) of the values of one group: how many (_k) are below a bracket (_v NULL) or _v inside it.

    A column's brackets ascend at both ends, so those a value is in or below follow from two binary searches.
    """
    limits: dict[str, list] = {}
    for r in brackets.orderBy("_c", "_p").collect():
        limits.setdefault(r["_c"], []).append((r["_p"], r["_rank"], r["_lo"], r["_hi"]))
    ends = {c: np.array(rows, dtype=float).T for c, rows in limits.items()}
    names = ["_g", "_c", "_p", "_rank", "_lo", "_hi", "_v", "_k"]

    def table(c: str, at: np.ndarray, v: pa.Array, k: np.ndarray) -> pa.RecordBatch:
        texts = [pa.array([text] * len(at), pa.string()) for text in ("", c)]
        return pa.RecordBatch.from_arrays([*texts, *[pa.array(x[at]) for x in ends[c]], v, pa.array(k, pa.int64())], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = {c: np.zeros(len(x[0]) + 1, np.int64) for c, x in ends.items()}
        for batch in batches:
            column = batch.column(0).dictionary_encode()
            which, found = column.indices.to_numpy(), batch.column(1).to_numpy()
            for i, c in enumerate(column.dictionary.to_pylist()):
                if c not in ends:
                    continue
                _, _, low, high = ends[c]
                v, k = np.unique(found[which == i], return_counts=True)
                first, last = np.searchsorted(high, v, side="left"), np.searchsorted(low, v, side="right")
                np.add.at(below[c], last, k)
                times = np.maximum(last - first, 0)
                row = np.repeat(np.arange(len(v)), times)
                at = first[row] + np.arange(len(row)) - np.repeat(times.cumsum() - times, times)
                yield table(c, at, pa.array(v[row]), k[row])
        for c, k in below.items():
            at = np.flatnonzero(k[:-1].cumsum())
            yield table(c, at, pa.nulls(len(at), pa.float64()), k[:-1].cumsum()[at])

    schema = "_g string, _c string, _p double, _rank double, _lo double, _hi double, _v double, _k long"
    return values.select("_c", "_v").mapInArrow(count, schema)


def _narrowed_quantiles(slim, by, wanted, probabilities, accuracy) -> DataFrame:
    # a group id without NULLs, so that groups can be joined back
    group = F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"}) if by else F.lit("")
    columns = list(probabilities)
    many = not by and max(map(len, probabilities.values())) >= MANY  # then tables of them, not expressions a quantile

    # stored: sizes, sketches and brackets all read it, and again with each widening
    values = reuse(slim.select(
        group.alias("_g"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])
        ).alias("_cell"),
    ).select("_g", "_cell.*").filter(F.col("_v").isNotNull()))

    every_p = sorted({p for ps in probabilities.values() for p in ps})
    sizes = reuse(values.groupBy("_g", "_c").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
    ))

    reach = 2.0 / accuracy
    while True:
        edges = sorted({max(0.0, p - reach) for p in every_p} | {min(1.0, p + reach) for p in every_p})
        sketch = values.groupBy("_g", "_c").agg(
            F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), accuracy).alias("_edge")
        )
        places = [
            (c, p, edges.index(max(0.0, p - reach)) + 1, edges.index(min(1.0, p + reach)) + 1, p - reach <= 0, p + reach >= 1)
            for c in columns for p in probabilities[c]
        ]
        names = ["c", "_p", "lo_at", "hi_at", "open_low", "open_high"]
        sketched = attach(sketch, sizes, ["_g", "_c"], "inner")
        if many:
            kinds = "c string, _p double, lo_at int, hi_at int, open_low boolean, open_high boolean"
            target = slim.sparkSession.createDataFrame(places, kinds).select(F.struct(*names).alias("_t"))
            aimed = sketched.join(F.broadcast(target), F.col("_t.c") == F.col("_c"))
        else:
            targets = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(place, names)]) for place in places])
            aimed = sketched.withColumn("_t", F.explode(F.filter(targets, lambda t: t["c"] == F.col("_c"))))
        brackets = reuse(
            aimed.select(
                "_g", "_c", "_t._p",
                (F.col("_t._p") * (F.col("_n") - 1)).alias("_rank"),
                F.when(F.col("_t.open_low"), F.col("_min"))
                .otherwise(F.element_at("_edge", F.col("_t.lo_at"))).alias("_lo"),
                F.when(F.col("_t.open_high"), F.col("_max"))
                .otherwise(F.element_at("_edge", F.col("_t.hi_at"))).alias("_hi"),
            )
        )
        if many:
            pairs = _bracketed(values, brackets)
        else:
            # one row per group and column with its few brackets as an array: a plain key lookup
            packed = brackets.groupBy("_g", "_c").agg(
                F.collect_list(F.struct("_p", "_rank", "_lo", "_hi")).alias("_b")
            )
            pairs = attach(values, packed, ["_g", "_c"], "inner").select(
                "_g", "_c", "_v", F.explode("_b").alias("_b")
            ).select("_g", "_c", "_v", "_b.*").filter(F.col("_v") <= F.col("_hi")).withColumn(
                "_v", F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))
            ).withColumn("_k", F.lit(1))
        # ties collapse before the shuffle; all values below a bracket collapse to one row
        kept = reuse(pairs.groupBy("_g", "_c", "_p", "_rank", "_lo", "_hi", "_v").agg(F.sum("_k").alias("_k")))
        span = kept.groupBy("_g", "_c", "_p", "_rank").agg(
            F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_k"))), F.lit(0)).alias("_below"),
            F.sum("_k").alias("_up_to"),
        )
        missed = span.filter(
            (F.col("_below") > F.floor("_rank")) | (F.col("_up_to") <= F.ceil("_rank"))
        )
        if missed.limit(1).count() == 0:
            break
        reach *= 4

    # a bracket is summed up slot by slot; only the slots that hold a wanted rank are sorted
    share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    slot = F.when(F.col("_v").isNull(), -1).when(F.col("_hi") > F.col("_lo"), F.least(F.floor(share * SLOTS), F.lit(SLOTS - 1))).otherwise(0)
    kept = kept.withColumn("_slot", slot.cast("int"))
    bracket = ["_g", "_c", "_p"]
    low, high = F.floor("_rank"), F.ceil("_rank")
    upto = Window.partitionBy(*bracket).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = kept.groupBy(*bracket, "_rank", "_slot").agg(F.sum("_k").alias("_size")).withColumn("_stop", F.sum("_size").over(upto))
    start = F.col("_stop") - F.col("_size")
    holding = slots.filter((F.col("_slot") >= 0) & (start <= high) & (low < F.col("_stop")))
    holding = reuse(holding.select(*bracket, "_slot", start.alias("_start")))
    inside = Window.partitionBy(*bracket, "_slot").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = attach(kept, holding, [*bracket, "_slot"], "inner").withColumn("_end", F.col("_start") + F.sum("_k").over(inside))
    holds = lambda rank: (F.col("_end") - F.col("_k") <= rank) & (rank < F.col("_end"))
    found = ranked.groupBy(*bracket).agg(
        F.max(F.when(holds(low), F.col("_v"))).alias("_x"),
        F.max(F.when(holds(high), F.col("_v"))).alias("_y"),
        F.max(F.col("_rank") - low).alias("_w"),
    ).withColumn("_q", F.col("_x") + (F.col("_y") - F.col("_x")) * F.col("_w"))

    if many:
        got = {(r["_c"], r["_p"]): r["_q"] for r in found.select("_c", "_p", "_q").collect()}
        kinds = T.StructType([T.StructField(alias, T.DoubleType()) for alias in wanted])
        return slim.sparkSession.createDataFrame([tuple(got.get(at) for at in wanted.values())], kinds)

    wide = found.groupBy("_g").agg(*[
        F.max(F.when((F.col("_c") == c) & (F.col("_p") == p), F.col("_q"))).alias(alias)
        for alias, (c, p) in wanted.items()
    ])
    keys = slim.select(group.alias("_g"), *by).distinct()
    result = attach(keys, wide, ["_g"], "left")
    return result.select(*by, *[F.col(a).cast(T.DoubleType()) for a in wanted])
