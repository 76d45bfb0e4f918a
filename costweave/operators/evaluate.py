"""Accuracy metrics, calibrated bands and per-country reports on log predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave import fixed_values as fv
from costweave.functions import numbers as num
from costweave.operators.lookup import attach
from costweave.operators.quantiles import exact_quantiles


def with_errors(df: DataFrame, true_log: str = "log_cost", pred_log: str = "pred_log") -> DataFrame:
    """Add err (signed relative error on the original scale) and abs_err.

    Rows without truth or prediction are left out: no report counts them.
    """
    known = df.filter(F.col(true_log).isNotNull() & F.col(pred_log).isNotNull())
    return known.withColumn("err", num.relative_error(F.col(true_log), F.col(pred_log))).withColumn(
        "abs_err", F.abs("err")
    )


def _fit_sums(true_log: str, pred_log: str) -> dict[str, Column]:
    residual = F.col(true_log) - F.col(pred_log)
    return {
        "n": F.count(F.lit(1)),
        "_sse": F.sum(residual * residual),
        "_mse": F.avg(residual * residual),
        "mae_log": F.avg(F.abs(residual)),
        "_sst": F.var_pop(true_log) * F.count(true_log),
        "_success": F.avg(F.when(F.col("abs_err") < fv.SUCCESS_ERROR, 1.0).otherwise(0.0)),
    }


def _r2() -> Column:
    """1 - SSE/SST (it can be negative); for equal truths 1 for a perfect fit and 0 otherwise."""
    return F.when(F.col("_sst") > 0, 1 - F.try_divide(F.col("_sse"), F.col("_sst"))).when(F.col("_sse") == 0, 1.0).when(
        F.col("n") > 0, 0.0
    )


def compute_metrics(
    df: DataFrame,
    by: Sequence[str] = (),
    true_log: str = "log_cost",
    pred_log: str = "pred_log",
) -> DataFrame:
    """Metrics per group (one row without `by`).

    n, r2_log, rmse_log, mae_log, mdape, median_bias_pct, success_30, q10_multiplier, q90_multiplier.
    Bias is the median signed error; the multipliers are 1 + the 10th / 90th percentile of the error, guarded. df is read twice: pass a stored table or
    something cheap on top of one.
    """
    by = list(by)
    errors = with_errors(df.select(*by, true_log, pred_log), true_log, pred_log)
    found = exact_quantiles(errors, by, {
        "_mdape": ("abs_err", 0.5), "_bias": ("err", 0.5), "_p10": ("err", 0.1), "_p90": ("err", 0.9),
    }, also=_fit_sums(true_log, pred_log))
    q10, q90 = 1 + F.col("_p10"), 1 + F.col("_p90")
    return found.select(
        *by, "n",
        _r2().alias("r2_log"),
        F.sqrt("_mse").alias("rmse_log"),
        "mae_log",
        (F.col("_mdape") * 100).alias("mdape"),
        (F.col("_bias") * 100).alias("median_bias_pct"),
        (F.col("_success") * 100).alias("success_30"),
        num.safe_q10(q10).alias("q10_multiplier"),
        num.safe_q90(q10, q90).alias("q90_multiplier"),
    )


def metrics_by_fold(df: DataFrame, fold: str = "fold") -> DataFrame:
    """(fold, n, r2_log, mae_log)."""
    sums = [value.alias(name) for name, value in _fit_sums("log_cost", "pred_log").items()]
    return with_errors(df).groupBy(fold).agg(*sums).select(
        fold, "n", _r2().alias("r2_log"), "mae_log"
    )


def bands_by_mode(df: DataFrame, mode: str = "mode", min_rows: int = fv.MIN_MODE_ROWS) -> DataFrame:
    """(mode, n, q10_multiplier, q90_multiplier) for modes with enough rows. df is read twice."""
    errors = with_errors(df).filter(F.col(mode).isNotNull()).select(mode, "err")
    found = exact_quantiles(
        errors, [mode], {"_p10": ("err", 0.1), "_p90": ("err", 0.9)}, also={"n": F.count("err")}
    )
    q10, q90 = 1 + F.col("_p10"), 1 + F.col("_p90")
    return found.filter(F.col("n") >= min_rows).select(
        mode, "n", num.safe_q10(q10).alias("q10_multiplier"), num.safe_q90(q10, q90).alias("q90_multiplier")
    )


def country_report(df: DataFrame, min_rows: int = fv.MIN_COUNTRY_ROWS) -> DataFrame:
    """Per country: n, median true and predicted cost, R2, MdAPE and median bias; largest first.

    A country of one row has R2 0. df is read twice.
    """
    errors = with_errors(df.filter(F.col("country").isNotNull())).select(
        "country", "log_cost", "pred_log", "abs_err", "err",
        F.exp("log_cost").alias("true_cost"), F.exp("pred_log").alias("pred_cost"),
    )
    found = exact_quantiles(errors, ["country"], {
        "median_true": ("true_cost", 0.5), "median_pred": ("pred_cost", 0.5),
        "_mdape": ("abs_err", 0.5), "_bias": ("err", 0.5),
    }, also=_fit_sums("log_cost", "pred_log"))
    r2 = F.when(F.col("n") < 2, 0.0).otherwise(_r2())
    return found.filter(F.col("n") >= min_rows).select(
        "country", "n", "median_true", "median_pred", r2.alias("r2_log"),
        (F.col("_mdape") * 100).alias("mdape"), (F.col("_bias") * 100).alias("median_bias_pct"),
    ).orderBy(F.desc("n"), "country")


def report_head(report: DataFrame, rows: int = 10) -> DataFrame:
    """The report's first rows: largest countries, name as tie-break."""
    return report.orderBy(F.desc("n"), "country").limit(rows)


def prediction_band(df: DataFrame, bands: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Add lo and hi = pred x multipliers.

    `bands` is a one-row metrics table, or with `by` one row per key; missing multipliers (or no
    table) mean the default ones.
    """
    if bands is None:
        q10, q90 = F.lit(fv.DEFAULT_Q10), F.lit(fv.DEFAULT_Q90)
        joined = df
    else:
        slim = bands.select(
            *([by] if by else []),
            F.col("q10_multiplier").alias("_q10"), F.col("q90_multiplier").alias("_q90"),
        )
        if by is None and slim.limit(2).count() > 1:
            raise ValueError("bands for all rows must be one row; name their key with `by`")
        joined = attach(df, slim, [by]) if by else df.join(F.broadcast(slim), F.lit(True), "left")
        q10 = F.coalesce("_q10", F.lit(fv.DEFAULT_Q10))
        q90 = F.coalesce("_q90", F.lit(fv.DEFAULT_Q90))
    return joined.withColumns({"lo": F.col("pred") * q10, "hi": F.col("pred") * q90}).drop("_q10", "_q90")
