"""Cross-validation, evaluation and the final fit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave import fixed_values as fv
from costweave.operators import boost, encode, evaluate, features, folds
from costweave.session import reuse
from costweave.sources.state import TrainingState, load_tables, save_state
from costweave.sources.tables import read_clean_projects

# (training rows with features and log_cost, id column) -> fitted trees
Fit = Callable[[DataFrame, str], boost.BoostedTrees]


def absolute_gbt(**params) -> Fit:
    """Spark ML's absolute-loss GBT."""
    return lambda rows, id_col: boost.gbt_leaves(boost.fit_absolute_gbt(rows, **params))


class quantile_boost:
    """Quantile boosting with exact leaf quantiles; a Fit that also grows many models in the same jobs."""

    def __init__(self, **params):
        self.params = params

    def __call__(self, rows: DataFrame, id_col: str) -> boost.BoostedTrees:
        return boost.fit_quantile_boost(rows, id_col, **self.params)

    def fit_many(self, rows: DataFrame, id_col: str, model_col: str, models: int) -> list[boost.BoostedTrees]:
        return boost.fit_quantile_models(rows, id_col, model_col, models, **self.params)


def assign_folds(prepared: DataFrame, id_col: str, k: int = fv.FOLDS, bins: int = fv.COST_BINS, seed: int = fv.SEED) -> DataFrame:
    """Prepared training rows with cost_bin and a fold stratified by it."""
    binned = folds.quantile_bins(prepared, bins=bins)
    return folds.stratified_folds(binned, id_col, "cost_bin", k, seed, max_strata=bins + 1)


@dataclass
class FoldEncoders:
    country: DataFrame
    city: DataFrame
    means: DataFrame


def fit_fold_encoders(folded: DataFrame, k: int = fv.FOLDS) -> FoldEncoders:
    """Both encoders for all fold complements: one aggregation each."""
    return FoldEncoders(
        reuse(encode.fit_fold_encoders(folded, "country", m=fv.COUNTRY_SMOOTHING, folds=k)),
        reuse(encode.fit_fold_encoders(folded, "city", m=fv.CITY_SMOOTHING, folds=k)),
        reuse(encode.fold_global_means(folded, folds=k)),
    )


def encode_for_fold(rows: DataFrame, encoders: FoldEncoders, fold=None) -> DataFrame:
    """Encode rows as seen from outside `fold` (default: each row's own)."""
    rows = encode.apply_fold_encoder(rows, encoders.country, encoders.means, "country", fold)
    return encode.apply_fold_encoder(rows, encoders.city, encoders.means, "city", fold)


def _model_input(rows: DataFrame, id_col: str) -> DataFrame:
    """What a fit reads, stored because it reads it many times."""
    return reuse(rows.select(id_col, *fv.FEATURES, "log_cost"))


def _fold_rows(folded: DataFrame, encoders: FoldEncoders, id_col: str, k: int) -> DataFrame:
    """Training rows of all k fold models, told apart by _model: fold i's rows are not in model i."""
    known = [f for f in fv.FEATURES if f in folded.columns]  # all but the encodings
    rows = folded.select(id_col, "fold", "country", "city", *known, "log_cost")
    # looked up before the rows are spread over the models
    rows = encode.attach_fold_encoder(rows, encoders.country, "country")
    rows = encode.attach_fold_encoder(rows, encoders.city, "city").crossJoin(F.broadcast(encoders.means))
    each = F.explode(F.array(*[F.lit(i) for i in range(k)]))
    spread = rows.withColumn("_model", each).filter(F.col("fold") != F.col("_model"))
    seen = {name: value for key in ("country", "city") for name, value in encode.seen_from_fold(key, F.col("_model")).items()}
    return spread.withColumns(seen).select("_model", id_col, *fv.FEATURES, "log_cost")


def _out_of_fold(folded: DataFrame, encoders: FoldEncoders, models) -> DataFrame:
    """One lookup for all models: a row's own fold decides what it sees."""
    encoded = encode_for_fold(folded, encoders)
    parts = [boost.predict(encoded.filter(F.col("fold") == i), model) for i, model in enumerate(models)]
    return reduce(DataFrame.unionByName, parts)


def cross_validate(prepared: DataFrame, id_col: str, fit: Fit, k: int = fv.FOLDS) -> DataFrame:
    """Prepared rows with cost_bin, fold, encodings and the out-of-fold prediction pred_log.

    Fold i's model sees encodings learned outside fold i, in training and in validation rows alike. A learner
    with `fit_many` gets the rows of all folds at once.
    """
    folded = reuse(assign_folds(prepared, id_col, k))
    encoders = fit_fold_encoders(folded, k)
    if hasattr(fit, "fit_many"):
        return _out_of_fold(folded, encoders, fit.fit_many(_fold_rows(folded, encoders, id_col, k), id_col, "_model", k))
    spread = reuse(_fold_rows(folded, encoders, id_col, k))  # one lookup for the rows of all models
    models = [fit(spread.filter(F.col("_model") == i).drop("_model"), id_col) for i in range(k)]
    return _out_of_fold(folded, encoders, models)


@dataclass
class TrainingReport:
    predictions: DataFrame
    metrics: DataFrame
    by_fold: DataFrame
    countries: DataFrame


def train(prepared: DataFrame, id_col: str, fit: Fit, k: int = fv.FOLDS) -> TrainingReport:
    """Cross-validate and report."""
    return _report(reuse(cross_validate(prepared, id_col, fit, k)))


def _report(predictions: DataFrame) -> TrainingReport:
    return TrainingReport(
        predictions, evaluate.compute_metrics(predictions),
        evaluate.metrics_by_fold(predictions), evaluate.country_report(predictions),
    )


def encode_all(prepared: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with whole-table encodings, and the country encoder, city encoder and global mean."""
    country = reuse(encode.fit_encoder(prepared, "country", m=fv.COUNTRY_SMOOTHING))
    city = reuse(encode.fit_encoder(prepared, "city", m=fv.CITY_SMOOTHING))
    mean = reuse(encode.global_mean(prepared))
    return encode.two_level_lookup(prepared, country, city, mean, city_fallback="global"), country, city, mean


def finalize(
    prepared: DataFrame, medians: DataFrame, id_col: str, fit: Fit, report: DataFrame, countries: DataFrame
) -> TrainingState:
    """Fit on everything and gather what scoring needs."""
    rows, country, city, mean = encode_all(prepared)
    model = fit(_model_input(rows, id_col), id_col)
    return TrainingState(model, country, city, mean, medians, report, countries)


def train_and_finalize(
    prepared: DataFrame, medians: DataFrame, id_col: str, fit: Fit, k: int = fv.FOLDS
) -> tuple[TrainingReport, TrainingState]:
    """Cross-validation and the fit on everything; a learner with `fit_many` grows all k + 1 models together."""
    if not hasattr(fit, "fit_many"):
        report = train(prepared, id_col, fit, k)
        return report, finalize(prepared, medians, id_col, fit, report.metrics, report.countries)
    folded = reuse(assign_folds(prepared, id_col, k))
    encoders = fit_fold_encoders(folded, k)
    rows, country, city, mean = encode_all(prepared)
    final = rows.select(F.lit(k).alias("_model"), id_col, *fv.FEATURES, "log_cost")
    *models, model = fit.fit_many(_fold_rows(folded, encoders, id_col, k).unionByName(final), id_col, "_model", k + 1)
    report = _report(reuse(_out_of_fold(folded, encoders, models)))
    return report, TrainingState(model, country, city, mean, medians, report.metrics, report.countries)


def load_and_prepare(spark, path: str, target: str = fv.TARGET) -> tuple[DataFrame, DataFrame]:
    """(prepared rows, training medians) of a stored clean table; rows get an id if they have none."""
    df = read_clean_projects(spark, path)
    medians = reuse(features.train_medians(features.training_rows(df, target)))
    return features.prepare_training(df, target, medians=medians.first()), medians


def with_row_id(df: DataFrame, id_col: str = "project_id") -> DataFrame:
    """Number the rows once and keep the numbers (ids must not change between jobs)."""
    return reuse(df.withColumn(id_col, F.monotonically_increasing_id()))


def run(spark, clean_path: str, out_folder: str, fit: Fit, id_col: str = "project_id") -> TrainingState:
    """Load, cross-validate, report, fit on everything and save the state."""
    prepared, medians = load_and_prepare(spark, clean_path)
    if id_col not in prepared.columns:
        prepared = with_row_id(prepared, id_col)
    report, state = train_and_finalize(prepared, medians, id_col, fit)
    save_state(state, out_folder, spark, {"oof_predictions": report.predictions.select(id_col, "fold", "log_cost", "pred_log")})
    return state


def read_oof_predictions(spark, out_folder: str) -> DataFrame:
    """(id, fold, log_cost, pred_log) of the last run."""
    return load_tables(spark, out_folder)["oof_predictions"]
