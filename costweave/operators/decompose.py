"""Subsystem shares per mode and the split of a predicted cost into subsystems."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave import fixed_values as fv
from costweave.functions import numbers as num
from costweave.operators.lookup import attach
from costweave.session import reuse
from costweave.operators.quantiles import exact_quantiles

SHARES = list(fv.SUBSYSTEM_SHARES)
LABELS = list(fv.SUBSYSTEM_SHARES.values())


def require_share_columns(df: DataFrame) -> None:
    missing = [c for c in ["mode", *SHARES] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def _normalised(medians: Mapping[str, Column]) -> dict[str, Column]:
    """Medians divided by their sum. Without a positive sum: equal shares. A missing one stays NULL."""
    total = sum((F.coalesce(m, F.lit(0.0)) for m in medians.values()), F.lit(0.0))
    equal = F.lit(1.0 / len(medians))
    return {c: F.when(total > 0, m / total).otherwise(equal) for c, m in medians.items()}


def subsystem_ratios(df: DataFrame, forced_global: Sequence[str] = tuple(fv.FORCED_GLOBAL_MODES)) -> DataFrame:
    """One row per mode and one for all rows (is_global): 8 ratios, n_projects and flags.

    A row counts for its mode and for the whole table; both come from one grouping. Rows without a
    mode count for the whole table only. Modes in forced_global get the ratios of the whole table.
    """
    require_share_columns(df)
    slots = F.array(
        F.struct(F.lit(True).alias("is_global"), F.lit(None).cast("string").alias("mode")),
        F.struct(F.lit(False).alias("is_global"), F.col("mode").cast("string").alias("mode")),
    )
    slim = reuse(df.select("mode", *SHARES))
    grouped = (
        slim.select(F.explode(slots).alias("_slot"), *SHARES)
        .select("_slot.*", *SHARES)
        .filter(F.col("is_global") | F.col("mode").isNotNull())
    )
    with_n = exact_quantiles(
        grouped, ["is_global", "mode"], {c: (c, 0.5) for c in SHARES}, also={"n_projects": F.count(F.lit(1))}
    )
    own = with_n.withColumns(_normalised({c: F.col(c) for c in SHARES}))
    whole = own.filter("is_global").select(*[F.col(c).alias(f"_all_{c}") for c in SHARES])
    forced = ~F.col("is_global") & F.col("mode").isin(list(forced_global))
    return own.crossJoin(F.broadcast(whole)).select(
        "mode", "is_global", "n_projects",
        forced.alias("forced_global"),
        (~F.col("is_global") & ~forced & (F.col("n_projects") < fv.SMALL_SAMPLE)).alias("low_n"),
        *[F.when(forced, F.col(f"_all_{c}")).otherwise(F.col(c)).alias(c) for c in SHARES],
    )


def ratios_long(ratios: DataFrame) -> DataFrame:
    """(mode, is_global, n_projects, ordinal, subsystem, ratio)."""
    return ratios.select(
        "mode", "is_global", "n_projects", F.explode(_share_array()).alias("_")
    ).select("mode", "is_global", "n_projects", "_.*")


def _share_array(columns: Mapping[str, Column] | None = None) -> Column:
    """The eight shares of a row as an array of (ordinal, subsystem, ratio)."""
    columns = columns or {c: F.col(c) for c in SHARES}
    return F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(label).alias("subsystem"), columns[c].alias("ratio"))
        for i, (c, label) in enumerate(fv.SUBSYSTEM_SHARES.items())
    ])


def mode_variability(ratios: DataFrame) -> DataFrame:
    """(mode, is_global, variability): spread of the ratios over their mean, within 0-1."""
    long = ratios_long(ratios)
    spread = F.try_divide(F.stddev_pop("ratio"), F.avg("ratio"))
    return long.groupBy("mode", "is_global").agg(
        F.avg("ratio").alias("_mean"), spread.alias("_spread")
    ).select(
        "mode", "is_global",
        F.when(F.col("_mean") == 0, 0.5)
        .otherwise(F.least(F.greatest(F.col("_spread"), F.lit(0.0)), F.lit(1.0))).alias("variability"),
    )


def requested_variability(requests: DataFrame, ratios: DataFrame, mode: str = "transit_mode") -> DataFrame:
    """Requests with the variability of their mode, or of the whole table for a mode without ratios."""
    known = reuse(mode_variability(ratios))
    whole = known.filter("is_global").agg(F.max("variability").alias("_whole"))  # one row
    own = known.filter("NOT is_global").select(F.col("mode").alias(mode), F.col("variability").alias("_own"))
    joined = attach(requests, own, [mode]).crossJoin(F.broadcast(whole))
    return joined.withColumn("variability", F.coalesce("_own", "_whole")).drop("_own", "_whole")


def attach_ratios(predictions: DataFrame, ratios: DataFrame, mode: str = "transit_mode") -> DataFrame:
    """Add the 8 ratios of each row's mode, n_projects and fallback_used.

    An unknown mode gets the whole table's ratios and n_projects 0. A missing mode column means the
    default mode.
    """
    if mode not in predictions.columns:
        predictions = predictions.withColumn(mode, F.lit(fv.DEFAULT_MODE))
    known = ratios.filter(~F.col("is_global")).select(
        F.col("mode").alias(mode), F.col("n_projects").alias("_n"),
        *[F.col(c).alias(f"_own_{c}") for c in SHARES],
    )
    whole = ratios.filter("is_global").select(*[F.col(c).alias(f"_all_{c}") for c in SHARES])
    joined = attach(predictions, known, [mode]).crossJoin(F.broadcast(whole))
    unknown = F.col("_n").isNull()
    return joined.withColumns({
        **{c: F.when(unknown, F.col(f"_all_{c}")).otherwise(F.col(f"_own_{c}")) for c in SHARES},
        "n_projects": F.coalesce("_n", F.lit(0)),
        "fallback_used": unknown,
    }).drop("_n", *[f"_own_{c}" for c in SHARES], *[f"_all_{c}" for c in SHARES])


def breakdown(
    predictions: DataFrame, ratios: DataFrame, id_col: str = "request_id", mode: str = "transit_mode"
) -> DataFrame:
    """(id, mode, ordinal, subsystem, ratio, point): eight rows per prediction."""
    rows = attach_ratios(predictions.select(id_col, mode, "pred"), ratios, mode)
    return rows.select(id_col, mode, "pred", F.explode(_share_array()).alias("_")).select(
        id_col, mode, "_.*", (F.col("pred") * F.col("_.ratio")).alias("point")
    )


def breakdown_interval(
    predictions: DataFrame,
    ratios: DataFrame | None,
    bands: DataFrame | None = None,
    id_col: str = "request_id",
    mode: str = "transit_mode",
) -> DataFrame:
    """Eight rows per prediction: ratio, point, lo, hi per km, n_projects, fallback_used.

    Ratios stay at their medians; the band's multipliers are the only source of uncertainty. Without
    a ratio table the default ratios apply (n_projects 0) and the multipliers are taken as they are.
    """
    keep = [id_col, mode, "pred", *(["length_km"] if "length_km" in predictions.columns else [])]
    if mode not in predictions.columns:
        predictions = predictions.withColumn(mode, F.lit(fv.DEFAULT_MODE))
    slim = predictions.select(*keep)
    if bands is None:
        q10, q90 = F.lit(fv.DEFAULT_Q10), F.lit(fv.DEFAULT_Q90)
    else:
        one = bands.select(F.col("q10_multiplier").alias("_q10"), F.col("q90_multiplier").alias("_q90"))
        if one.limit(2).count() > 1:
            raise ValueError("bands for all rows must be one row")
        slim = slim.join(F.broadcast(one), F.lit(True), "left")
        q10 = F.coalesce("_q10", F.lit(fv.DEFAULT_Q10))
        q90 = F.coalesce("_q90", F.lit(fv.DEFAULT_Q90))
    if ratios is None:
        shares = _share_array({c: F.lit(fv.DEFAULT_RATIOS[label]) for c, label in fv.SUBSYSTEM_SHARES.items()})
        rows = slim.withColumns({"n_projects": F.lit(0).cast("bigint"), "fallback_used": F.lit(True)})
        low, high = q10, q90
    else:
        shares = _share_array()
        rows = attach_ratios(slim, ratios, mode)
        low, high = num.safe_q10(q10), num.safe_q90(q10, q90)
    rows = rows.withColumns({"_low": low, "_high": high, "_share": F.explode(shares)})
    return rows.select(
        *keep, "_share.*",
        (F.col("pred") * F.col("_share.ratio")).alias("point"),
        (F.col("pred") * F.col("_low") * F.col("_share.ratio")).alias("lo"),
        (F.col("pred") * F.col("_high") * F.col("_share.ratio")).alias("hi"),
        "n_projects", "fallback_used",
    )


def breakdown_report(intervals: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Per subsystem: share of the prediction, costs per km and for the whole length (needs length_km)."""
    return intervals.select(
        id_col, "ordinal", F.col("subsystem").alias("category"),
        F.try_divide(F.col("point"), F.col("pred")).alias("ratio"),
        "point", "lo", "hi",
        (F.col("point") * F.col("length_km")).alias("total_point"),
        (F.col("lo") * F.col("length_km")).alias("total_lo"),
        (F.col("hi") * F.col("length_km")).alias("total_hi"),
    )
