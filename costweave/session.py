"""Session set-up, and tables that are written once and read by several jobs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "costweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        # a local-cluster master has executors of its own, which need a folder that is named
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="costweave-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_scopes: list[list[str]] = []


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store, whatever file system it is on; a missing one is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that reuse() stores inside are deleted at the end: write or collect what is wanted before it."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            delete_folder(spark, folder)


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A runtime setting that holds inside, and is as it was before afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def store(df: DataFrame, folder: str) -> None:
    """Write a table as Parquet; its shuffle files go when it is written, not with some later garbage collection."""
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(folder)


def reuse(df: DataFrame) -> DataFrame:
    """Write a table that several jobs read, and read it back.

    Ends the lineage: later plans are short, see real sizes and scan only the columns they need, and
    nothing is recomputed when an executor is lost.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope.append(folder)
    store(df, folder)
    return spark.read.schema(df.schema).parquet(folder)
