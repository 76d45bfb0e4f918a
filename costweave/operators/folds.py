"""Quantile bins and balanced, shuffled, stratified folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from costweave import fixed_values as fv
from costweave.operators.lookup import BROADCAST_ROWS, attach
from costweave.session import reuse
from costweave.operators.quantiles import exact_quantiles

BUCKET_ROWS = 50_000  # rows of the table that a bucket of the shuffled order holds at most, about


def quantile_edges(df: DataFrame, column: str = "log_cost", bins: int = fv.COST_BINS) -> list[float]:
    """The inner edges of equally filled bins. Repeated edges are refused. df is read twice."""
    row = exact_quantiles(df, [], {f"e{i}": (column, i / bins) for i in range(1, bins)}).first()
    edges = [row[f"e{i}"] for i in range(1, bins)]
    if any(e is None for e in edges) or any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError(f"bin edges must be unique: {edges}")
    return edges


def quantile_bins(
    df: DataFrame,
    column: str = "log_cost",
    bins: int = fv.COST_BINS,
    bin_name: str = "cost_bin",
    edges: list[float] | None = None,
) -> DataFrame:
    """Add the right-closed quantile bin 0 .. bins-1 of a column (NULL for NULL)."""
    edges = quantile_edges(df, column, bins) if edges is None else edges
    above = [F.when(F.col(column) > e, 1).otherwise(0) for e in edges]
    which = F.when(F.col(column).isNotNull(), sum(above[1:], above[0]))
    return df.withColumn(bin_name, which)


def shuffle_key(id_col: Column, seed: int = fv.SEED) -> Column:
    """A reproducible random order of ids."""
    return F.md5(F.concat_ws("|", id_col.cast("string"), F.lit(str(seed))))


def stratified_folds(
    df: DataFrame,
    id_col: str,
    stratum: str = "cost_bin",
    folds: int = fv.FOLDS,
    seed: int = fv.SEED,
    max_strata: int | None = None,
) -> DataFrame:
    """Add a fold 0 .. folds-1, balanced within each stratum to one row.

    A row's fold is its place in the shuffled order of its stratum, modulo the number of folds. A
    stratum is a fifth of the table, so it is not ranked in one task: rows are ranked inside buckets
    of the shuffled order (evenly filled, as the order is a hash; as many as the rows ask for), and each bucket starts where the
    counts of the buckets before it end. Ids must be unique. `max_strata` is a known bound on the
    number of strata; without one the table of bucket starts is counted before it is broadcast.
    """
    rows, digits = df.count(), 1
    while 16**digits * BUCKET_ROWS < rows:
        digits += 1
    keyed = df.withColumn("_order", shuffle_key(F.col(id_col), seed)).withColumn("_bucket", F.substring("_order", 1, digits))
    counts = keyed.groupBy(stratum, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(stratum).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # a NULL stratum is one of its own: keys are JSON, which keeps it apart from any value
    key = F.to_json(F.struct(F.col(stratum).alias("s")))
    starts = counts.select(
        key.alias("_stratum"), "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(stratum, "_bucket").orderBy("_order", id_col)
    ranked = keyed.withColumn("_place", F.row_number().over(inside) - 1).withColumn(
        "_stratum", key
    )
    keys = ["_stratum", "_bucket"]
    if max_strata is not None and max_strata * 16**digits <= BROADCAST_ROWS:
        placed = ranked.join(F.broadcast(starts), keys)
    else:
        placed = attach(ranked, reuse(starts), keys, "inner")
    return placed.withColumn(
        "fold", F.pmod(F.col("_start") + F.col("_place"), F.lit(folds)).cast("int")
    ).drop("_order", "_bucket", "_start", "_place", "_stratum")
