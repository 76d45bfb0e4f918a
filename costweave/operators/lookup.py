"""Key lookups that neither broadcast unchecked nor pile a hot key onto one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costweave.session import reuse

# A lookup table is broadcast only when a count proves it has at most this many rows ...
BROADCAST_ROWS = 200_000
# ... and cells; an element of an array counts as a cell for each of its fields.
BROADCAST_CELLS = 2_000_000
# Beyond that both sides are shuffled, and keys with at least this many fact rows are salted ...
HOT_KEY_ROWS = 2_000_000
# ... or this share of all rows, which bounds how many keys are salted.
HOT_KEY_SHARE = 1 / 100_000
# A salted key is spread so that a task gets about this many of its rows.
TASK_ROWS = 500_000


def _cells(schema: T.StructType) -> Column:
    """Cells of a row, all elements of its arrays counted."""
    def width(kind):
        return len(kind.fields) if isinstance(kind, T.StructType) else 1

    arrays = [f for f in schema.fields if isinstance(f.dataType, T.ArrayType)]
    # one number for all plain fields: a sum with a term a field takes the analyzer a round a term, of which it has 100
    total = F.lit(sum(width(f.dataType) for f in schema.fields if f not in arrays)).cast("long")
    for field in arrays:
        total = total + F.coalesce(F.size(field.name), F.lit(0)).cast("long") * F.lit(width(field.dataType.elementType)).cast("long")
    return total


def fits_broadcast(dim: DataFrame, rows: int | None = None) -> bool:
    """True when dim is proven small, by rows and by cells. Counts at most one row past the bound.

    Pass a stored table or something cheap on top of one: it is read for the count too.
    """
    bound = BROADCAST_ROWS if rows is None else rows
    found = dim.limit(bound + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(_cells(dim.schema)).alias("cells")).first()
    return found["rows"] <= bound and (found["cells"] or 0) <= BROADCAST_CELLS


def attach(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    broadcast_rows: int | None = None,
    hot_key_rows: int = HOT_KEY_ROWS,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Join fact to dim, where dim has one row per key (inner or left).

    Small dim: broadcast. Larger dim: shuffled join in which every hot key of fact is spread over
    as many tasks as its rows ask for, and its single dim row is copied to each of them.
    """
    on = list(on)
    if fits_broadcast(dim, broadcast_rows):
        return fact.join(F.broadcast(dim), on, how)
    return salted_attach(fact, dim, on, how, hot_key_rows, task_rows)


def salted_attach(
    fact: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left",
    hot_key_rows: int = HOT_KEY_ROWS, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """The shuffled way of attach. A NULL key in fact matches nothing but is spread out too.

    fact is stored first: it is counted, then joined, and its plan must not be built for each.
    """
    on = list(on)
    fact = reuse(fact)
    some_key_null = F.lit(False)
    for key in on:
        some_key_null = some_key_null | F.col(key).isNull()
    rows, nulls = fact.agg(F.count(F.lit(1)), F.coalesce(F.sum(some_key_null.cast("long")), F.lit(0))).first()
    # every key from the threshold on; there are at most 1 / HOT_KEY_SHARE of them
    threshold = max(hot_key_rows, int(rows * HOT_KEY_SHARE))
    hot = reuse(
        fact.filter(~some_key_null).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") >= threshold)
        .select(*on, F.ceil(F.col("_rows") / task_rows).cast("int").alias("_salts"))
    )
    null_salts = max(1, -(-nulls // task_rows))
    salts = F.when(some_key_null, F.lit(null_salts)).otherwise(F.coalesce("_salts", F.lit(1)))
    # the task number spreads exact copies of a row too, and is the same when a task is repeated
    row_salt = F.pmod(F.xxhash64(*fact.columns, F.spark_partition_id()), salts).cast("int")
    left = fact.join(F.broadcast(hot), on, "left").withColumn("_salt", row_salt).drop("_salts")
    right = (
        dim.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def literal_table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A table of fixed values, built in the JVM (no Python worker)."""
    names = [part.split()[0] for part in schema.split(",")]
    types = [part.split()[1] for part in schema.split(",")]
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(row, names, types)]) for row in rows
    ]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")
