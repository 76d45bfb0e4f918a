"""Units, prices and the subsystem cost table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costweave import fixed_values as fv
from costweave.functions import numbers as num
from costweave.functions.headers import rename_to_snake


def clean_dollars(df: DataFrame, columns=tuple(fv.DOLLAR_COLUMNS)) -> DataFrame:
    """Parse currency text; anything unparsable becomes NULL."""
    return df.withColumns({c: num.parse_dollars(F.col(c).cast("string")) for c in columns if c in df.columns})


def parse_plain_numbers(df: DataFrame, columns) -> DataFrame:
    """Parse those of the listed columns that were read as text."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.withColumns({c: num.parse_number(F.col(c)) for c in columns if c in text})


def miles_to_km(df: DataFrame, lengths=fv.MILE_LENGTHS) -> DataFrame:
    return df.withColumns({
        km: F.col(miles) * fv.KM_PER_MILE for miles, km in lengths.items() if miles in df.columns
    })


def per_mile_to_per_km(df: DataFrame, costs=fv.PER_MILE_COSTS) -> DataFrame:
    return df.withColumns({
        per_km: F.col(per_mile) / fv.KM_PER_MILE for per_mile, per_km in costs.items() if per_mile in df.columns
    })


def totals_per_km(df: DataFrame, totals=fv.TOTALS_PER_KM, length: str = "length_km") -> DataFrame:
    """Totals divided by length; NULL where the length is zero."""
    if length not in df.columns:
        return df
    return df.withColumns({
        per_km: F.try_divide(F.col(total), F.col(length)) for total, per_km in totals.items() if total in df.columns
    })


def clean_cpi(raw: DataFrame) -> DataFrame:
    """Price-index table, five columns bound by position, to (year, index_2023).

    Rows whose year is no number are notes and are dropped.
    """
    named = raw.toDF("year", "cpi_value", "unused", "index_2021", "index_2023")
    year = num.parse_number(F.col("year").cast("string"))
    return named.select(
        F.floor(year).cast("int").alias("year"),
        num.parse_number(F.col("index_2023").cast("string")).alias("index_2023"),
    ).filter(F.col("year").isNotNull())


def cpi_multiplier(cpi: DataFrame, year: int = fv.PRICE_YEAR, column: str = "index_2023") -> DataFrame:
    """One row (multiplier): the index at `year`. The query fails unless there is exactly one."""
    found = cpi.filter(F.col("year") == year).agg(
        F.count(F.lit(1)).alias("_n"), F.max(column).alias("_value")
    )
    message = F.concat(F.lit(f"price index needs one row for {year}, has "), F.col("_n").cast("string"))
    return found.select(
        F.when(F.col("_n") == 1, F.col("_value"))
        .otherwise(F.raise_error(message).cast("double")).alias("multiplier")
    )


def inflated_columns() -> list[str]:
    """The dollar and per-km columns that get a `_2023` copy."""
    return [*fv.DOLLAR_COLUMNS, *fv.PER_MILE_COSTS.values(), *fv.TOTALS_PER_KM.values()]


def inflate(df: DataFrame, multiplier: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add <column>_2023 = column x multiplier. The multiplier is one row (a scalar aggregate)."""
    targets = [c for c in (columns or inflated_columns()) if c in df.columns]
    joined = df.crossJoin(F.broadcast(multiplier.select(F.col("multiplier").alias("_multiplier"))))
    return joined.withColumns({f"{c}_2023": F.col(c) * F.col("_multiplier") for c in targets}).drop("_multiplier")


def clean_subsystems(raw: DataFrame, cpi: DataFrame) -> DataFrame:
    """Raw subsystem cost table to one in km and in 2023 prices."""
    df = rename_to_snake(raw, fv.SUBSYSTEM_HEADER_EXCEPTIONS)
    df = clean_dollars(df)
    df = parse_plain_numbers(df, [*fv.SHARE_CHECK_COLUMNS, *fv.MILE_LENGTHS, "year", "vehicles", "stations"])
    df = df.transform(miles_to_km).transform(per_mile_to_per_km).transform(totals_per_km)
    return inflate(df, cpi_multiplier(cpi))
