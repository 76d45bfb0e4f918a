"""Smoothed target encodings, frequencies and their lookups, whole-table and per fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costweave import fixed_values as fv
from costweave.operators.lookup import attach


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _has_keys(keys: list[str]) -> Column:
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return present


def smoothed(total: Column, n: Column, global_mean: Column, m: float) -> Column:
    """Key mean shrunk towards the global mean with the weight of m rows."""
    return (total + m * global_mean) / (n + m)


# ---- whole-table encoder --------------------------------------------------

def global_mean(df: DataFrame, target: str = "log_cost") -> DataFrame:
    """One row (global_mean)."""
    return df.agg(F.avg(target).alias("global_mean"))


def fit_encoder(
    df: DataFrame, key: str | Sequence[str], target: str = "log_cost", m: float = fv.ENCODER_SMOOTHING
) -> DataFrame:
    """(key, te, freq): smoothed encoding and row count of every non-NULL key.

    Target sums and counts are combined before the shuffle, so a hot key costs one row per task. The
    global mean comes from the keys' own sums and needs no second scan (the exchange is reused).
    Store the result where it is looked up.
    """
    keys = _keys(key)
    stats = df.groupBy(*keys).agg(
        F.sum(target).alias("_total"), F.count(target).alias("_n"), F.count(F.lit(1)).alias("freq"),
    )
    overall = stats.agg((F.sum("_total") / F.sum("_n")).alias("_mean"))
    te = smoothed(F.coalesce("_total", F.lit(0.0)), F.col("_n"), F.col("_mean"), m)
    # a key without any target has no mean and is encoded as unseen
    return (
        stats.filter(_has_keys(keys)).crossJoin(F.broadcast(overall))
        .select(*keys, F.when(F.col("_n") > 0, te).alias("te"), "freq")
    )


def apply_encoder(
    df: DataFrame,
    encoder: DataFrame,
    mean: DataFrame,
    key: str | Sequence[str],
    te_name: str | None = None,
    freq_name: str | None = None,
    unseen_freq: int = 1,
) -> DataFrame:
    """Add the encoding and frequency of each row's key; unseen keys get the global mean."""
    keys = _keys(key)
    te_name = te_name or f"{'_'.join(keys)}_te"
    freq_name = freq_name or f"{'_'.join(keys)}_freq"
    dim = encoder.select(*keys, F.col("te").alias("_te"), F.col("freq").alias("_freq"))
    joined = attach(df, dim, keys, "left").crossJoin(
        F.broadcast(mean.select(F.col("global_mean").alias("_mean")))
    )
    return joined.withColumns({
        te_name: F.coalesce("_te", "_mean"),
        freq_name: F.coalesce("_freq", F.lit(unseen_freq)),
    }).drop("_te", "_freq", "_mean")


def two_level_lookup(
    requests: DataFrame,
    country_encoder: DataFrame,
    city_encoder: DataFrame,
    mean: DataFrame,
    city_fallback: str = "country",
    unseen_freq: int = 1,
) -> DataFrame:
    """Add country_te, country_freq, city_te and city_freq.

    An unseen city falls back to its country and then to the global mean ('country', the rule for
    scoring) or straight to the global mean ('global', the rule for training).
    """
    countries = country_encoder.select(
        "country", F.col("te").alias("_country_te"), F.col("freq").alias("_country_freq")
    )
    cities = city_encoder.select("city", F.col("te").alias("_city_te"), F.col("freq").alias("_city_freq"))
    joined = attach(requests, countries, ["country"])
    joined = attach(joined, cities, ["city"]).crossJoin(
        F.broadcast(mean.select(F.col("global_mean").alias("_mean")))
    )
    fallbacks = ["_city_te", "_country_te", "_mean"] if city_fallback == "country" else ["_city_te", "_mean"]
    return joined.withColumns({
        "country_te": F.coalesce("_country_te", "_mean"),
        "country_freq": F.coalesce("_country_freq", F.lit(unseen_freq)).cast("double"),
        "city_te": F.coalesce(*fallbacks),
        "city_freq": F.coalesce("_city_freq", F.lit(unseen_freq)).cast("double"),
    }).drop("_country_te", "_country_freq", "_city_te", "_city_freq", "_mean")


def market_context(
    requests: DataFrame, country_encoder: DataFrame, city_encoder: DataFrame, mean: DataFrame
) -> DataFrame:
    """Add city_baseline, country_baseline (log cost) and sample_density (projects in the city)."""
    looked_up = two_level_lookup(requests, country_encoder, city_encoder, mean, unseen_freq=0)
    return looked_up.withColumnsRenamed({
        "city_te": "city_baseline", "country_te": "country_baseline", "city_freq": "sample_density",
    }).withColumn("sample_density", F.col("sample_density").cast("bigint")).drop("country_freq")


# ---- encoder per fold complement ------------------------------------------

def fit_fold_encoders(
    df: DataFrame,
    key: str | Sequence[str],
    target: str = "log_cost",
    m: float = fv.ENCODER_SMOOTHING,
    folds: int = fv.FOLDS,
    fold: str = "fold",
) -> DataFrame:
    """(key, te_by_fold, freq_by_fold): entry i holds what the rows outside fold i say.

    One aggregation over the data gives each key's sums per fold; a fold's complement is the key's
    total less the fold's own part. No loop over folds and no fold-times-rows blow-up. Keys unseen
    outside fold i have that complement's global mean and a NULL frequency. Store the result where it
    is looked up.
    """
    keys = _keys(key)
    own = lambda value, i: F.when(F.col(fold) == i, value)
    stats = df.groupBy(*keys).agg(
        F.array(*[F.coalesce(F.sum(own(F.col(target), i)), F.lit(0.0)) for i in range(folds)]).alias("_s"),
        F.array(*[F.count(own(F.col(target), i)) for i in range(folds)]).alias("_n"),
        F.array(*[F.count(own(F.lit(1), i)) for i in range(folds)]).alias("_r"),
    )
    fold_at = lambda name, i: F.element_at(name, i + 1)
    overall = stats.agg(
        F.array(*[F.sum(fold_at("_s", i)) for i in range(folds)]).alias("_gs"),
        F.array(*[F.sum(fold_at("_n", i)) for i in range(folds)]).alias("_gn"),
    )

    def outside(name, i):
        others = [fold_at(name, j) for j in range(folds) if j != i]
        return sum(others[1:], others[0])

    def encoding(i):
        mean = F.try_divide(outside("_gs", i), outside("_gn", i))
        seen = outside("_n", i) > 0
        return F.when(seen, smoothed(outside("_s", i), outside("_n", i), mean, m)).otherwise(mean)

    def frequency(i):
        return F.when(outside("_r", i) > 0, outside("_r", i))

    return stats.filter(_has_keys(keys)).crossJoin(F.broadcast(overall)).select(
        *keys,
        F.array(*[encoding(i) for i in range(folds)]).alias("te_by_fold"),
        F.array(*[frequency(i) for i in range(folds)]).alias("freq_by_fold"),
    )


def fold_global_means(
    df: DataFrame, target: str = "log_cost", folds: int = fv.FOLDS, fold: str = "fold"
) -> DataFrame:
    """One row (mean_by_fold): mean target outside each fold."""
    return df.agg(F.array(*[F.avg(F.when(F.col(fold) != i, F.col(target))) for i in range(folds)]).alias("mean_by_fold"))


def fold_encoder_table(encoder: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """(key, fold, te, freq): the fold encoders in long form, every key x fold pair."""
    return encoder.select(
        *_keys(key),
        F.posexplode(F.arrays_zip("te_by_fold", "freq_by_fold")).alias("fold", "_"),
    ).select(*_keys(key), "fold", F.col("_.te_by_fold").alias("te"), F.col("_.freq_by_fold").alias("freq"))


def apply_fold_encoder(
    df: DataFrame,
    encoder: DataFrame,
    means: DataFrame,
    key: str,
    fold: Column | None = None,
    te_name: str | None = None,
    freq_name: str | None = None,
) -> DataFrame:
    """Add the encoding learned outside `fold` (default: the row's own fold).

    Pass a literal fold to encode all rows, training ones too, with the same complement.
    """
    joined = attach_fold_encoder(df, encoder, key).crossJoin(F.broadcast(means))
    seen = seen_from_fold(key, F.col("fold") if fold is None else fold, te_name, freq_name)
    return joined.withColumns(seen).drop(f"_{key}_te", f"_{key}_freq", "mean_by_fold")


def attach_fold_encoder(df: DataFrame, encoder: DataFrame, key: str) -> DataFrame:
    """Add the encodings and frequencies outside every fold as arrays, one lookup for all folds."""
    dim = encoder.select(key, F.col("te_by_fold").alias(f"_{key}_te"), F.col("freq_by_fold").alias(f"_{key}_freq"))
    return attach(df, dim, [key], "left")


def seen_from_fold(key: str, fold: Column, te_name: str | None = None, freq_name: str | None = None) -> dict[str, Column]:
    """Encoding and frequency outside `fold`, from the arrays of attach_fold_encoder and mean_by_fold."""
    at = fold + 1
    return {
        te_name or f"{key}_te": F.coalesce(F.element_at(f"_{key}_te", at), F.element_at("mean_by_fold", at)),
        freq_name or f"{key}_freq": F.coalesce(F.element_at(f"_{key}_freq", at), F.lit(1)).cast("double"),
    }
