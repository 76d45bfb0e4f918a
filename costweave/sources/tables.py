"""Table readers and writers: CSV and Parquet, with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from costweave import fixed_values as fv
from costweave.operators.cleanse import drop_without_target, nan_to_null_everywhere
from costweave.functions import numbers as num
from pyspark.sql import functions as F

#: cells of a raw CSV that mean a missing value (fixed values)
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)

CLEAN_PROJECT_SCHEMA = T.StructType([
    T.StructField(
        name,
        T.DoubleType()
        if name in fv.SLASH_NUMBER_COLUMNS + fv.PLAIN_NUMBER_COLUMNS + ["real_cost_2023_musd"] else T.StringType(),
    )
    for name in fv.PROJECT_COLUMNS.values()
])


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def found(read, path: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise ValueError(f"cannot read {path}: {error}") from error


def positional_names(headers: Sequence[str | None]) -> list[str]:
    """One name a column, by position: a repeated header gets `.1`, `.2`, ...; one without text its place."""
    seen: dict[str, int] = {}
    names = []
    for place, header in enumerate(headers):
        header = header if header else f"Unnamed: {place}"
        nth = seen.get(header, 0)
        seen[header] = nth + 1
        names.append(f"{header}.{nth}" if nth else header)
    return names


def read_raw(
    spark: SparkSession, path: str, schema: T.StructType | None = None, missing_words: Sequence[str] = MISSING_WORDS,
    line_breaks: bool = False,
) -> DataFrame:
    """A raw table: Parquet, or CSV with a header whose cells all stay text.

    CSV columns are bound by position, so a header may repeat; cells that are one of missing_words are NULL.
    A given CSV schema saves the look at the header. line_breaks: quoted cells may hold line breaks; each file is
    then read by one task.
    """
    if path.rstrip("/").endswith(".parquet"):
        return nan_to_null_everywhere(found(lambda: spark.read.parquet(path), path))
    reader = spark.read.option("multiLine", line_breaks).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
    if schema is None:
        head = found(lambda: reader.option("header", False).csv(path), path).first()
        schema = text_schema(positional_names(head) if head else [])
    rows = found(lambda: reader.option("header", True).schema(schema).option("enforceSchema", True).csv(path), path)
    words = list(missing_words)
    quoted = [F.col("`" + f.name.replace("`", "``") + "`") for f in schema]
    return rows.select(*[
        F.when(~c.isin(words), c).alias(f.name) if words and isinstance(f.dataType, T.StringType) else c.alias(f.name)
        for c, f in zip(quoted, schema)
    ])


def read_raw_projects(spark: SparkSession, path: str) -> DataFrame:
    return read_raw(spark, path)


def read_raw_subsystems(spark: SparkSession, path: str) -> DataFrame:
    return read_raw(spark, path)


def read_raw_cpi(spark: SparkSession, path: str) -> DataFrame:
    """The price-index table; its columns are bound by position when it is cleaned."""
    return read_raw(spark, path)


def read_clean(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A clean table: Parquet, or CSV with the given schema by column name (inferred without one)."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True).option("escape", '"')
        if schema is None:
            return nan_to_null_everywhere(found(lambda: reader.option("inferSchema", True).csv(path), path))
        text = found(lambda: reader.csv(path), path)
        # by name, so a file with fewer or reordered columns is read right
        typed = [
            num.parse_number(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in schema if f.name in text.columns
        ]
        return text.select(*typed)
    return nan_to_null_everywhere(found(lambda: spark.read.parquet(path), path))


def read_clean_projects(spark: SparkSession, path: str) -> DataFrame:
    return read_clean(spark, path, CLEAN_PROJECT_SCHEMA)


def read_clean_subsystems(spark: SparkSession, path: str) -> DataFrame:
    return read_clean(spark, path)


def read_similarity_projects(spark: SparkSession, path: str) -> DataFrame | None:
    """Clean projects with a known cost and tunnel shares as 0-1; None without the table."""
    try:
        df = read_clean_projects(spark, path)
    except FileNotFoundError:
        return None
    return drop_without_target(df).withColumn("tunnel_pct", num.share_0_1(F.col("tunnel_pct")))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a Parquet table, or a CSV one when the path ends in .csv (a folder either way)."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.rstrip("/").endswith(".csv"):
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)
