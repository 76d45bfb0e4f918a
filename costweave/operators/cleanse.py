"""Cleaning of the project table and its data-quality reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costweave import fixed_values as fv
from costweave.functions import numbers as num


def keep_known_columns(df: DataFrame, columns: Sequence[str] = tuple(fv.PROJECT_COLUMNS)) -> DataFrame:
    """The listed columns that exist, in list order."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def rename_known_columns(df: DataFrame, names: Mapping[str, str] = fv.PROJECT_COLUMNS) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


# ---- row filters ----------------------------------------------------------

def drop_without_place(df: DataFrame) -> DataFrame:
    """Drop rows that have neither country nor city."""
    return df.dropna(how="all", subset=["country", "city"])


def drop_without_target(df: DataFrame, target: str = fv.TARGET) -> DataFrame:
    return df.dropna(subset=[target])


def drop_without_tunnel(df: DataFrame) -> DataFrame:
    """Drop rows that lack tunnel length or tunnel share."""
    return df.dropna(how="any", subset=["tunnel_km", "tunnel_pct"])


def drop_outlier_lines(
    df: DataFrame, lines: Sequence[str] = tuple(fv.OUTLIER_LINES), column: str = "line"
) -> DataFrame:
    """Drop the listed lines; a row without a line name stays."""
    return df.filter(~F.coalesce(F.col(column).isin(list(lines)), F.lit(False)))


# ---- numbers --------------------------------------------------------------

def _number_parsers(columns: Sequence[str]) -> dict[str, Column]:
    parsers = {c: num.parse_slash_number for c in fv.SLASH_NUMBER_COLUMNS}
    parsers |= {c: num.parse_number for c in fv.PLAIN_NUMBER_COLUMNS}
    return {c: parse(F.col(c).cast("string")) for c, parse in parsers.items() if c in columns}


def parse_numbers(df: DataFrame) -> DataFrame:
    """Parse the numeric columns that exist; dirty cells become NULL."""
    return df.withColumns(_number_parsers(df.columns))


def clean_projects(raw: DataFrame) -> DataFrame:
    """Raw project table to clean one. Rows are filtered on the raw cells, before parsing."""
    df = rename_known_columns(keep_known_columns(raw))
    df = df.transform(drop_without_place).transform(drop_without_target).transform(drop_without_tunnel)
    return df.transform(parse_numbers)


# ---- quality reports (one pass each) --------------------------------------

def unpivot_counts(counts: DataFrame, key: str, value: str) -> DataFrame:
    """One row of named counts to (key, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias(key), F.col(c).alias(value)) for c in counts.columns])
    return counts.select(F.explode(pairs).alias("_")).select("_.*")


def row_drop_report(df: DataFrame, target: str = fv.TARGET) -> DataFrame:
    """(rule, dropped_rows): how many rows each filter removes of those the earlier ones left."""
    no_place = F.col("country").isNull() & F.col("city").isNull()
    no_target = F.col(target).isNull()
    no_tunnel = F.col("tunnel_km").isNull() | F.col("tunnel_pct").isNull()
    counts = df.agg(
        F.count_if(no_place).alias("country_and_city_missing"),
        F.count_if(~no_place & no_target).alias("target_missing"),
        F.count_if(~no_place & ~no_target & no_tunnel).alias("tunnel_missing"),
    )
    return unpivot_counts(counts, "rule", "dropped_rows")


def new_null_report(df: DataFrame) -> DataFrame:
    """(column_name, new_nulls): cells that were filled but do not parse."""
    counts = df.agg(*[
        F.count_if(F.col(c).isNotNull() & parsed.isNull()).alias(c)
        for c, parsed in _number_parsers(df.columns).items()
    ])
    return unpivot_counts(counts, "column_name", "new_nulls")


def null_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, nulls) for the listed columns that exist."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns if c in df.columns])
    return unpivot_counts(counts, "column_name", "nulls")


def share_range_report(df: DataFrame, columns: Sequence[str] = tuple(fv.SHARE_CHECK_COLUMNS)) -> DataFrame:
    """(column_name, out_of_range): values outside 0-1. Only reports, changes nothing."""
    counts = df.agg(*[
        F.count_if((F.col(c) < 0) | (F.col(c) > 1)).alias(c) for c in columns if c in df.columns
    ])
    return unpivot_counts(counts, "column_name", "out_of_range")


def mode_check_report(df: DataFrame, modes: Sequence[str] = tuple(fv.TRANSIT_MODES)) -> DataFrame:
    """(mode, n_rows, known): rows per mode and whether the mode is a listed one."""
    return df.groupBy("mode").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "known", F.coalesce(F.col("mode").isin(list(modes)), F.lit(False))
    )


def nan_to_null_everywhere(df: DataFrame) -> DataFrame:
    """Turn every NaN of a DOUBLE or FLOAT column into NULL."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: num.nan_to_null(F.col(f"`{c}`")) for c in floats})
