"""Spark helpers of the package: tables, free column names, connected components."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.session import delete_folder, reuse


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(stored: DataFrame) -> None:
    """Delete a table that reuse() stored, once what is read in its place stands."""
    for file in stored.inputFiles()[:1]:
        delete_folder(stored.sparkSession, file.rsplit("/", 1)[0])


FILTER_BITS = 1 << 26  # of the bitmap of maybe_in: 8 MB, whatever the number of keys
_SPOT = 8 * 4096  # bits of a row of the bitmap


def maybe_in(rows: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """rows with a boolean `flag`, false only where `key` (a whole number or NULL) is not among keys.key.

    The keys set bits of a bitmap of fixed size, which is broadcast. Too many keys only make the answer vague: true
    for ever more rows that are not among them, never false for one that is. So it may save a shuffle of rows
    before an exact join, but never stands for one.
    """
    bucket, bits = free_name(rows, "_bucket"), free_name(rows, "_bits")
    at = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(FILTER_BITS))
    bitmap = keys.where(F.col(key).isNotNull()).select(at.alias("at")).groupBy(
        F.floor(F.col("at") / _SPOT).alias(bucket)
    ).agg(F.bitmap_construct_agg(F.col("at") % _SPOT).alias(bits))
    spot = at % _SPOT
    byte = F.conv(F.hex(F.substr(F.col(bits), (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    held = F.floor(byte / F.pow(F.lit(2), spot % 8)) % 2 == 1
    found = rows.withColumn(bucket, F.when(F.col(key).isNotNull(), F.floor(at / _SPOT))).join(F.broadcast(bitmap), bucket, "left")
    return found.select(*rows.columns, F.coalesce(held, F.lit(False)).alias(flag))


def free_name(df: DataFrame, wish: str) -> str:
    """`wish`, lengthened until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from every id that occurs in links (a long, b long).

    Large-star and small-star steps in turn, each stored in the shared folder, until nothing changes.
    A step only needs the least neighbour of each node, a minimum that is combined before the shuffle;
    the join that hands it back is one that Spark splits where a node has very many links. NULL ids and
    self links say nothing and are left out; an empty table gives an empty result.
    """
    edges = reuse(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = reuse(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        marks = [
            df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
            for df in (edges, after)
        ]
        edges = after
        if tuple(marks[0]) == tuple(marks[1]):
            break
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return reuse(members.unionByName(roots))


def fit_in_task(rows: DataFrame, fit):
    """fit(pandas rows) of a table of bounded size, run in one task; None for an empty table."""

    def run(batches):
        frames = [b for b in batches if len(b)]
        if frames:
            yield pd.DataFrame({"model": [pickle.dumps(fit(pd.concat(frames, ignore_index=True)))]})

    found = rows.repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(bytes(found[0]["model"])) if found else None
