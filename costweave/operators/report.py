"""Display text for reports (plain columns, no layout)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave import fixed_values as fv
from costweave.functions import numbers as num
from costweave.operators.lookup import attach, literal_table


def country_names(spark) -> DataFrame:
    """(country, country_name): the fixed code table."""
    return literal_table(spark, list(fv.COUNTRY_NAMES.items()), "country string, country_name string")


def add_country_name(df: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Add country_name; a code without a name is its own name."""
    names = country_names(df.sparkSession) if names is None else names
    return attach(df, names, ["country"]).withColumn("country_name", F.coalesce("country_name", "country"))


def headline_text(scored: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Cost per km, band and total budget as text."""
    return scored.select(
        id_col,
        num.money_text(F.col("pred"), 0, " M").alias("cost_per_km"),
        F.concat(num.money_text(F.col("lo"), 0), F.lit(" – "), num.money_text(F.col("hi"), 0, " M")).alias("band"),
        F.concat(
            F.lit("$"), num.fixed_text(num.total_budget_billions(F.col("pred"), F.col("length_km")), 2), F.lit(" B")
        ).alias("budget"),
    )


def breakdown_text(report: DataFrame, id_col: str = "request_id") -> DataFrame:
    """A breakdown report as display text."""
    return report.select(
        id_col, "ordinal", "category",
        num.percent_text(F.col("ratio")).alias("share"),
        num.money_text(F.col("point"), 1).alias("point_per_km"),
        num.money_range_text(F.col("lo"), F.col("hi"), 1).alias("range_per_km"),
        num.money_text(F.col("total_point"), 0, "M").alias("total_point_text"),
        num.money_range_text(F.col("total_lo"), F.col("total_hi"), 0, "M").alias("total_range_text"),
    )


def hover_text(report: DataFrame, id_col: str = "request_id") -> DataFrame:
    """The range of each category per km, as shown over a chart."""
    low, high = num.money_text(F.col("lo"), 1), num.money_text(F.col("hi"), 1, " M/km")
    return report.select(id_col, "ordinal", "category", F.concat(low, F.lit(" – "), high).alias("range_str"))


def summary_text(requests: DataFrame, id_col: str = "request_id") -> DataFrame:
    """What was asked for: place, length and tunnel share, stations, mode. A missing part leaves its text NULL."""
    named = add_country_name(requests)
    return named.select(
        id_col,
        F.concat("city", F.lit(", "), "country_name").alias("location"),
        F.concat(num.fixed_text(F.col("length_km"), 1), F.lit(" km / "), num.whole_percent_text(F.col("tunnel_pct")), F.lit(" Tunnel")).alias("topology"),
        F.concat(F.col("num_stations").cast("int").cast("string"), F.lit(" Units")).alias("stations"),
        F.coalesce("transit_mode", F.lit("—")).alias("mode"),
    )


def context_text(context: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Market context as display text (baselines back on the cost scale)."""
    return context.select(
        id_col,
        num.money_text(F.exp("city_baseline"), 0, " M/km").alias("city_baseline_text"),
        num.money_text(F.exp("country_baseline"), 0, " M/km").alias("country_baseline_text"),
        F.concat(F.col("sample_density").cast("string"), F.lit(" Projects")).alias("sample_density_text"),
    )


def similar_text(similar: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Similar projects as display text: match, place, line, length, tunnel share and cost."""
    named = add_country_name(similar)
    return named.select(
        id_col, "rank",
        F.concat(num.match_percent(F.col("score")).cast("string"), F.lit("%")).alias("match"),
        "country_name", "city", "line",
        num.fixed_text(F.col("length_km"), 1).alias("length_text"),
        num.whole_percent_text(F.col("tunnel_pct")).alias("tunnel_text"),
        num.money_text(F.col("cost_per_km_2023_musd"), 0, " M").alias("cost_text"),
        "same_place",
    )
