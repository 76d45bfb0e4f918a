"""Model features and training-time imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from costweave import fixed_values as fv
from costweave.functions import numbers as num
from costweave.operators.cleanse import drop_outlier_lines, drop_without_target
from costweave.operators.quantiles import exact_quantiles


def base_features(df: DataFrame) -> DataFrame:
    """Feature columns for which the inputs exist, in one projection."""
    have = set(df.columns)
    c = F.col
    features = {}
    if "tunnel_pct" in have:
        features["tunnel_pct"] = num.share_0_1(c("tunnel_pct"))
    if {"num_stations", "length_km"} <= have:
        features["station_density"] = num.station_density(c("num_stations"), c("length_km"))
    if "length_km" in have:
        features["log_length"] = num.safe_log(c("length_km"))
    if {"start_year", "end_year"} <= have:
        features["mid_year"] = num.mid_year(c("start_year"), c("end_year"))
    if "is_regional_rail" in have:
        features["is_regional_rail"] = F.coalesce(c("is_regional_rail").cast("double"), F.lit(0.0))
    return df.withColumns(features)


def training_rows(
    df: DataFrame, target: str = fv.TARGET, outliers: Sequence[str] = tuple(fv.OUTLIER_LINES)
) -> DataFrame:
    return drop_outlier_lines(drop_without_target(df, target), outliers)


def train_medians(rows: DataFrame) -> DataFrame:
    """One row (num_stations, mid_year): medians over the training rows, before any fill.

    rows is read twice: pass a stored table or something cheap on top of one.
    """
    values = rows.select(
        F.col("num_stations").cast("double").alias("num_stations"),
        num.mid_year(F.col("start_year"), F.col("end_year")).alias("mid_year"),
    )
    return exact_quantiles(values, [], {"num_stations": ("num_stations", 0.5), "mid_year": ("mid_year", 0.5)})


def prepare_training(
    df: DataFrame,
    target: str = fv.TARGET,
    outliers: Sequence[str] = tuple(fv.OUTLIER_LINES),
    medians: Row | None = None,
) -> DataFrame:
    """Training table: filtered, imputed with training medians, with features and log_cost.

    The two medians go into the plan as constants. df is read for them (see train_medians) unless they
    are given as a row of train_medians.
    """
    rows = training_rows(df, target, outliers)
    fills = train_medians(rows).first() if medians is None else medians
    filled = rows.withColumn(
        "num_stations", F.coalesce(F.col("num_stations").cast("double"), F.lit(fills["num_stations"]).cast("double"))
    )
    return base_features(filled).withColumns({
        "mid_year": F.coalesce(num.mid_year(F.col("start_year"), F.col("end_year")), F.lit(fills["mid_year"]).cast("double")),
        "log_cost": num.safe_log(F.col(target)),
    })
