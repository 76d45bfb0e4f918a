"""Named queries over the stand-in tables, one per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costweave import fixed_values as fv
from costweave.functions import headers
from costweave.functions import numbers as num
from costweave.operators import (
    boost, cleanse, decompose, drivers, encode, evaluate, features, folds, normalize, report, similar,
)
from costweave.operators.lookup import attach
from costweave.operators.quantiles import exact_quantiles
from costweave.session import reuse, shared_folder
from costweave.plans import scoring, training
from costweave.sources import stand_ins as src
from costweave.sources import quarantine, tables
from costweave.sources.state import TrainingState, load_state, save_state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EXCLUDED_LINES = ["O1", "O7", "O21"]
FORCED_MODE = "MACHINERY"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, decimals: int = 6) -> DataFrame:
    """All DOUBLE columns rounded (and -0 as 0), for comparison between engines."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, decimals) + 0.0 for c in doubles})


def stored_projects(spark: SparkSession, sf: str) -> DataFrame:
    """The project stand-in, written once; a query hands it to all of its steps."""
    return reuse(src.projects(spark, sf))


def prepared(spark: SparkSession, sf: str, projects: DataFrame | None = None) -> DataFrame:
    """Training rows of the project stand-in: expressions on top of the stored projects."""
    return features.prepare_training(stored_projects(spark, sf) if projects is None else projects)


def folded(spark: SparkSession, sf: str, projects: DataFrame | None = None) -> DataFrame:
    return reuse(training.assign_folds(prepared(spark, sf, projects), "project_id").select(
        "project_id", "country", "city", "mode", "log_cost", "cost_bin", "fold"
    ))


def predictions(spark: SparkSession, sf: str, projects: DataFrame | None = None) -> DataFrame:
    """A deterministic predictor: the out-of-fold encoding of the city."""
    rows = folded(spark, sf, projects)
    encoder = reuse(encode.fit_fold_encoders(rows, "city", m=fv.CITY_SMOOTHING))
    encoded = encode.apply_fold_encoder(rows, encoder, encode.fold_global_means(rows), "city", te_name="pred_log")
    return encoded.select("project_id", "country", "mode", "fold", "log_cost", "pred_log")


def encoders(spark: SparkSession, sf: str, projects: DataFrame | None = None):
    rows = prepared(spark, sf, projects)
    country = reuse(encode.fit_encoder(rows, "country", m=fv.COUNTRY_SMOOTHING))
    city = reuse(encode.fit_encoder(rows, "city", m=fv.CITY_SMOOTHING))
    return country, city, encode.global_mean(rows)


def scored_by_lookup(spark: SparkSession, sf: str, projects: DataFrame | None = None) -> DataFrame:
    """Requests with pred = exp of their two-level city encoding."""
    projects = stored_projects(spark, sf) if projects is None else projects
    looked_up = encode.two_level_lookup(src.requests(spark, sf, projects), *encoders(spark, sf, projects))
    return looked_up.withColumn("pred", F.exp("city_te"))


def ratios(spark: SparkSession, sf: str) -> DataFrame:
    return reuse(decompose.subsystem_ratios(src.subsystems(spark, sf), [FORCED_MODE]))


# ---- cleaning ---------------------------------------------------------------

@query
def cleanse_slash(spark, sf):
    raw = src.raw_projects(spark, sf)
    return rounded(raw.select(
        F.col("Project id").alias("project_id"), F.col("Stations").alias("raw_text"),
        num.parse_slash_number(F.col("Stations")).alias("num_stations"),
    ))


@query
def cleanse_year_float(spark, sf):
    raw = src.raw_projects(spark, sf)
    return rounded(raw.select(
        F.col("Project id").alias("project_id"),
        num.parse_number(F.col("Start year")).alias("start_year"),
        num.parse_number(F.col("Length")).alias("length_km"),
        num.parse_number(F.col("TunnelPer")).alias("tunnel_pct"),
    ))


@query
def cleanse_dollars(spark, sf):
    raw = headers.rename_to_snake(src.raw_subsystems(spark, sf), fv.SUBSYSTEM_HEADER_EXCEPTIONS)
    return rounded(normalize.clean_dollars(raw).select("customer_id", "project_cost", "cost_per_mile", "soft_costs"), 2)


@query
def clean_projects(spark, sf):
    raw = src.raw_projects(spark, sf)
    return rounded(cleanse.clean_projects(raw))


def as_csv(df: DataFrame) -> str:
    """A raw table as CSV files with headers in the shared folder, NULL as the word N/A."""
    folder = f"{shared_folder(df.sparkSession)}/raw/{uuid.uuid4().hex}"
    df.write.option("header", True).option("escape", '"').option("nullValue", "N/A").csv(folder)
    return folder


@query
def clean_projects_from_csv(spark, sf):
    """Raw files as they come: text cells, missing values as words."""
    raw = src.raw_projects(spark, sf)
    return rounded(cleanse.clean_projects(tables.read_raw_projects(spark, as_csv(raw))))


@query
def quality_row_drops_from_csv(spark, sf):
    raw = tables.read_raw_projects(spark, as_csv(src.raw_projects(spark, sf)))
    return cleanse.row_drop_report(cleanse.rename_known_columns(raw))


@query
def raw_records_checked(spark, sf):
    """Raw lines of every project, some too short, too long or with an open quote: good rows and quarantine together."""
    raw = src.raw_projects(spark, sf)
    key = F.col("Project id")
    cells = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("N/A")) for c in raw.columns}
    cells["City"] = F.concat(F.lit('"'), cells["City"], F.lit(', ""old"""'))
    line = F.concat_ws(",", *cells.values())
    line = F.when(key % 17 == 0, F.concat(cells["Project id"], F.lit(",cut"))).when(
        key % 19 == 0, F.concat(line, F.lit(",more"))
    ).when(key % 23 == 0, F.concat(line, F.lit(',"open'))).otherwise(line)
    folder = f"{shared_folder(spark)}/raw/{uuid.uuid4().hex}"
    raw.select(line.alias(",".join(raw.columns))).write.option("header", True).option("sep", "\u0001").option(
        "quote", "\u0000"
    ).csv(folder)
    good, bad = quarantine.read_checked(spark, folder)
    return good.select(
        F.col("Project id").cast("bigint").alias("project_id"), F.col("City").alias("city"),
        F.col("Country").alias("country"), F.lit(None).cast("int").alias("n_cells"), F.lit(None).cast("string").alias("reason"),
    ).unionByName(bad.select(
        F.substring_index("record", ",", 1).cast("bigint").alias("project_id"), F.lit(None).cast("string").alias("city"),
        F.lit(None).cast("string").alias("country"), "n_cells", "reason",
    ))


@query
def quality_row_drops(spark, sf):
    return cleanse.row_drop_report(cleanse.rename_known_columns(src.raw_projects(spark, sf)))


@query
def quality_new_nulls(spark, sf):
    return cleanse.new_null_report(cleanse.rename_known_columns(src.raw_projects(spark, sf)))


@query
def quality_nulls(spark, sf):
    raw = headers.rename_to_snake(src.raw_subsystems(spark, sf), fv.SUBSYSTEM_HEADER_EXCEPTIONS)
    return cleanse.null_report(normalize.clean_dollars(raw), fv.DOLLAR_COLUMNS)


@query
def quality_pct_range(spark, sf):
    raw = headers.rename_to_snake(src.raw_subsystems(spark, sf), fv.SUBSYSTEM_HEADER_EXCEPTIONS)
    return cleanse.share_range_report(raw)


@query
def quality_known_modes(spark, sf):
    return cleanse.mode_check_report(src.subsystems(spark, sf), ["AUTOMOBILE", "BUILDING", "FURNITURE"])


@query
def outlier_exclusion(spark, sf):
    rows = src.projects(spark, sf).withColumn("line", F.when(F.col("project_id") % 10 != 6, F.col("line")))
    return rounded(features.training_rows(rows, outliers=EXCLUDED_LINES).select("project_id", "line", fv.TARGET))


# ---- units and prices -------------------------------------------------------

@query
def units_mile_to_km(spark, sf):
    return rounded(normalize.miles_to_km(src.subsystems(spark, sf)).select("project", "length_km", "tunnel_km"), 4)


@query
def unit_cost_per_km(spark, sf):
    raw = headers.rename_to_snake(src.raw_subsystems(spark, sf), fv.SUBSYSTEM_HEADER_EXCEPTIONS)
    df = normalize.per_mile_to_per_km(normalize.clean_dollars(raw))
    return rounded(df.select("customer_id", "cost_per_km", "guideway_costs_per_km"), 4)


@query
def subsystem_per_km(spark, sf):
    df = normalize.totals_per_km(normalize.miles_to_km(src.subsystems(spark, sf)))
    return rounded(df.select("project", *[c for c in fv.TOTALS_PER_KM.values() if c in df.columns]), 4)


@query
def cpi_clean(spark, sf):
    return rounded(normalize.clean_cpi(src.raw_cpi(spark, sf)))


@query
def cpi_multiplier(spark, sf):
    return rounded(normalize.cpi_multiplier(normalize.clean_cpi(src.raw_cpi(spark, sf)), src.CPI_YEAR))


@query
def inflate_costs(spark, sf):
    multiplier = normalize.cpi_multiplier(normalize.clean_cpi(src.raw_cpi(spark, sf)), src.CPI_YEAR)
    df = normalize.inflate(src.subsystems(spark, sf), multiplier)
    return rounded(df.select("project", *[c for c in df.columns if c.endswith("_2023")]), 2)


@query
def clean_subsystems(spark, sf):
    """The whole cleaning of the raw subsystem table. The price year is moved to the one its code asks for."""
    shift = fv.PRICE_YEAR - src.CPI_YEAR
    raw_cpi = src.raw_cpi(spark, sf).withColumn(
        "Year", F.coalesce((F.col("Year").try_cast("int") + shift).cast("string"), F.col("Year"))
    )
    df = normalize.clean_subsystems(src.raw_subsystems(spark, sf), normalize.clean_cpi(raw_cpi))
    return rounded(df, 2)


# ---- features ---------------------------------------------------------------

@query
def base_features(spark, sf):
    rows = src.projects(spark, sf).withColumn(
        "tunnel_pct", F.when(F.col("project_id") % 2 == 0, F.col("tunnel_pct") * 100).otherwise(F.col("tunnel_pct"))
    )
    return rounded(features.base_features(rows).select(
        "project_id", "tunnel_pct", "station_density", "log_length", "mid_year", "is_regional_rail"
    ))


def _with_gaps(spark, sf) -> DataFrame:
    key = F.col("project_id")
    return src.projects(spark, sf).withColumns({
        "num_stations": F.when(key % 10 != 4, F.col("num_stations")),
        "start_year": F.when(key % 10 != 5, F.col("start_year")),
    })


@query
def train_medians(spark, sf):
    return rounded(features.train_medians(features.training_rows(reuse(_with_gaps(spark, sf)), outliers=EXCLUDED_LINES)))


@query
def median_impute(spark, sf):
    rows = features.prepare_training(reuse(_with_gaps(spark, sf)), outliers=EXCLUDED_LINES)
    return rounded(rows.select("project_id", "num_stations", "station_density", "mid_year", "log_cost"))


# ---- encodings --------------------------------------------------------------

@query
def target_encode_country(spark, sf):
    return rounded(encode.fit_encoder(prepared(spark, sf), "country", m=fv.COUNTRY_SMOOTHING).select("country", "te"))


@query
def target_encode_city(spark, sf):
    return rounded(encode.fit_encoder(prepared(spark, sf), "city", m=fv.CITY_SMOOTHING).select("city", "te"))


@query
def target_encode_place(spark, sf):
    """A composite key, default smoothing."""
    return rounded(encode.fit_encoder(prepared(spark, sf), ["country", "mode"]))


@query
def frequency_encode(spark, sf):
    rows = prepared(spark, sf)
    encoder = reuse(encode.fit_encoder(rows, "country", m=fv.COUNTRY_SMOOTHING))
    encoded = encode.apply_encoder(rows, encoder, encode.global_mean(rows), "country")
    return rounded(encoded.select("project_id", "country", "country_te", "country_freq"))


@query
def two_level_fallback(spark, sf):
    projects = stored_projects(spark, sf)
    looked_up = encode.two_level_lookup(src.requests(spark, sf, projects), *encoders(spark, sf, projects))
    return rounded(looked_up.select("request_id", "country", "city", "country_te", "country_freq", "city_te", "city_freq"))


@query
def market_context(spark, sf):
    projects = stored_projects(spark, sf)
    context = encode.market_context(
        src.requests(spark, sf, projects).select("request_id", "country", "city"), *encoders(spark, sf, projects)
    )
    return rounded(context.select("request_id", "city_baseline", "country_baseline", "sample_density"))


@query
def market_context_text(spark, sf):
    projects = stored_projects(spark, sf)
    context = encode.market_context(
        src.requests(spark, sf, projects).select("request_id", "country", "city"), *encoders(spark, sf, projects)
    )
    return report.context_text(context)


# ---- folds ------------------------------------------------------------------

@query
def quantile_bins(spark, sf):
    return folds.quantile_bins(prepared(spark, sf)).select("project_id", "cost_bin")


@query
def stratified_folds(spark, sf):
    return folded(spark, sf).select("project_id", "cost_bin", "fold")


@query
def oof_target_encoding(spark, sf):
    """Every city x fold pair: encoding and frequency outside the fold."""
    encoder = encode.fit_fold_encoders(folded(spark, sf), "city", m=fv.CITY_SMOOTHING)
    return rounded(encode.fold_encoder_table(encoder, "city"))


@query
def oof_rows_encoded(spark, sf):
    """Every row with both encodings and frequencies from outside its fold."""
    rows = folded(spark, sf)
    encoded = training.encode_for_fold(rows, training.fit_fold_encoders(rows))
    return rounded(encoded.select("project_id", "fold", "country_te", "country_freq", "city_te", "city_freq"))


# ---- evaluation -------------------------------------------------------------

@query
def metrics_overall(spark, sf):
    return rounded(evaluate.compute_metrics(predictions(spark, sf)))


@query
def metrics_by_fold(spark, sf):
    return rounded(evaluate.metrics_by_fold(predictions(spark, sf)))


def gapped(df: DataFrame) -> DataFrame:
    """Some rows without a prediction."""
    return df.withColumn("pred_log", F.when(F.col("project_id") % 10 != 3, F.col("pred_log")))


@query
def metrics_by_fold_with_gaps(spark, sf):
    return rounded(evaluate.metrics_by_fold(gapped(predictions(spark, sf))))


@query
def country_report_with_gaps(spark, sf):
    return rounded(evaluate.country_report(gapped(predictions(spark, sf))), 4)


@query
def quantiles_narrowed(spark, sf):
    """The way of large tables, per country."""
    errors = reuse(evaluate.with_errors(predictions(spark, sf)))
    found = exact_quantiles(errors, ["country"], {
        "err_10": ("err", 0.1), "err_50": ("err", 0.5), "err_90": ("err", 0.9), "cost_50": ("log_cost", 0.5),
    }, direct_rows=0, accuracy=50)
    return rounded(found)


@query
def quantiles_narrowed_overall(spark, sf):
    errors = reuse(evaluate.with_errors(predictions(spark, sf)))
    return rounded(exact_quantiles(errors, [], {"err_10": ("err", 0.1), "err_50": ("err", 0.5)}, direct_rows=0, accuracy=50))


@query
def lookup_salted(spark, sf):
    """The way of large lookup tables: no broadcast, hot keys spread by their counts."""
    projects = stored_projects(spark, sf)
    asked = src.requests(spark, sf, projects).select("request_id", "country")
    countries = reuse(encode.fit_encoder(prepared(spark, sf, projects), "country", m=fv.COUNTRY_SMOOTHING).select("country", "te"))
    return rounded(attach(asked, countries, ["country"], broadcast_rows=0, hot_key_rows=100, task_rows=40))


@query
def bands_by_mode(spark, sf):
    return rounded(evaluate.bands_by_mode(predictions(spark, sf)))


@query
def country_report(spark, sf):
    return rounded(evaluate.country_report(predictions(spark, sf)), 4)


@query
def country_report_top10(spark, sf):
    return rounded(evaluate.report_head(evaluate.country_report(predictions(spark, sf))), 4)


# ---- decomposition ----------------------------------------------------------

@query
def subsystem_ratios(spark, sf):
    return rounded(ratios(spark, sf))


@query
def subsystem_summary(spark, sf):
    return rounded(decompose.ratios_long(ratios(spark, sf)))


@query
def mode_variability(spark, sf):
    return rounded(decompose.mode_variability(ratios(spark, sf)))


@query
def requested_variability(spark, sf):
    asked = src.requests(spark, sf).select("request_id", "transit_mode")
    return rounded(decompose.requested_variability(asked, ratios(spark, sf)))


@query
def cost_breakdown(spark, sf):
    scored = scored_by_lookup(spark, sf)
    return rounded(decompose.breakdown(scored, ratios(spark, sf)))


@query
def cost_breakdown_interval(spark, sf):
    projects = stored_projects(spark, sf)
    bands = reuse(evaluate.compute_metrics(predictions(spark, sf, projects)))
    intervals = decompose.breakdown_interval(scored_by_lookup(spark, sf, projects), ratios(spark, sf), bands)
    return rounded(intervals.drop("length_km", "pred"))


@query
def default_ratio_breakdown(spark, sf):
    intervals = decompose.breakdown_interval(scored_by_lookup(spark, sf), None)
    return rounded(intervals.select("request_id", "subsystem", "ratio", "point", "lo", "hi", "n_projects"))


@query
def breakdown_report(spark, sf):
    intervals = decompose.breakdown_interval(scored_by_lookup(spark, sf), ratios(spark, sf))
    return rounded(decompose.breakdown_report(intervals), 4)


@query
def breakdown_report_text(spark, sf):
    intervals = decompose.breakdown_interval(scored_by_lookup(spark, sf), ratios(spark, sf))
    return report.breakdown_text(decompose.breakdown_report(intervals))


@query
def breakdown_hover_text(spark, sf):
    intervals = decompose.breakdown_interval(scored_by_lookup(spark, sf), ratios(spark, sf))
    return report.hover_text(decompose.breakdown_report(intervals))


@query
def request_summary_text(spark, sf):
    return report.summary_text(src.requests(spark, sf))


# ---- scoring ----------------------------------------------------------------

@query
def valid_requests(spark, sf):
    return scoring.valid_requests(src.requests(spark, sf)).select("request_id", "start_year", "end_year")


@query
def prediction_band(spark, sf):
    """Predictions of valid requests with the calibrated band and the total budget."""
    projects = stored_projects(spark, sf)
    scored = scoring.valid_requests(scored_by_lookup(spark, sf, projects))
    banded = evaluate.prediction_band(scored, reuse(evaluate.compute_metrics(predictions(spark, sf, projects))))
    return rounded(banded.select(
        "request_id", "pred", "lo", "hi",
        num.total_budget_billions(F.col("pred"), F.col("length_km")).alias("total_budget_billions"),
    ))


@query
def headline_text(spark, sf):
    return report.headline_text(evaluate.prediction_band(scored_by_lookup(spark, sf)))


@query
def request_features(spark, sf):
    """All nine model inputs of every request."""
    projects = stored_projects(spark, sf)
    country, city, mean = encoders(spark, sf, projects)
    medians = features.train_medians(features.training_rows(projects))
    state = TrainingState(None, country, city, mean, medians, None, None)
    return rounded(scoring.request_features(src.requests(spark, sf, projects), state).select("request_id", *fv.FEATURES))


# ---- similar projects -------------------------------------------------------

def _similar(spark, sf, **how) -> tuple[DataFrame, DataFrame]:
    projects = stored_projects(spark, sf)
    candidates = projects.dropna(subset=[fv.TARGET])
    requests = src.requests(spark, sf, projects)
    return similar.similar_projects(requests, candidates, **how), candidates


@query
def similar_projects(spark, sf):
    return _similar_full(*_similar(spark, sf))


@query
def similar_projects_unbroadcast(spark, sf):
    """The way of large indexes: every level and the blocks joined without broadcast."""
    return _similar_full(*_similar(spark, sf, broadcast_nodes=0, broadcast_blocks=0))


def _similar_full(found: DataFrame, candidates: DataFrame) -> DataFrame:
    full = similar.with_project_columns(
        found, candidates,
        ["country", "city", "line", "start_year", "end_year", "length_km", "tunnel_pct", "num_stations", fv.TARGET],
    )
    return rounded(full)


@query
def similar_match_percent(spark, sf):
    """Display text of the similar projects; nations as codes with and without a name."""
    found, candidates = _similar(spark, sf)
    coded = candidates.withColumn("country", F.substring("country", 1, 2))
    full = similar.with_project_columns(found, coded, ["country", "city", "line", "length_km", "tunnel_pct", fv.TARGET])
    return report.similar_text(full)


# ---- drivers ----------------------------------------------------------------

LINEAR_DRIVERS = ["tunnel_pct", "station_density", "log_length", "is_regional_rail", "mid_year"]


@query
def driver_report_linear(spark, sf):
    return rounded(_linear_drivers(spark, sf))


@query
def driver_report_text(spark, sf):
    return drivers.driver_text(_linear_drivers(spark, sf), "project_id")


def _linear_drivers(spark, sf) -> DataFrame:
    """The report on simple contributions: each feature less its mean, scaled by position."""
    rows = prepared(spark, sf)
    means = rows.agg(*[F.avg(f).alias(f"_{f}") for f in LINEAR_DRIVERS])
    parts = rows.crossJoin(F.broadcast(means)).select(
        "project_id", *[F.round((F.col(f) - F.col(f"_{f}")) * (i + 1), 9).alias(f) for i, f in enumerate(LINEAR_DRIVERS)]
    )
    return drivers.driver_report(parts, "project_id", LINEAR_DRIVERS)


# ---- given and simple models, whose results SQL can tell ----------------------

#: (tree, leaf, value, rows, path of (feature, above, up to, share of rows))
_INF = float("inf")
HAND_MODEL = boost.BoostedTrees(["tunnel_pct", "log_length", "is_regional_rail"], 4.5, [
    (0, 0, 0.2, 30.0, [(0, -_INF, 0.3, 0.6), (1, -_INF, 3.0, 0.5)]),
    (0, 1, -0.1, 30.0, [(0, -_INF, 0.3, 0.6), (1, 3.0, _INF, 0.5)]),
    (0, 2, 0.4, 40.0, [(0, 0.3, _INF, 0.4)]),
    (1, 0, -0.3, 70.0, [(2, -_INF, 0.5, 0.7)]),
    (1, 1, 0.6, 30.0, [(2, 0.5, _INF, 0.3)]),
])


def median_learner(rows: DataFrame, id_col: str) -> boost.BoostedTrees:
    """No trees: the median of the complete rows."""
    known = reuse(rows.filter(boost.complete() & F.col("log_cost").isNotNull()).select("log_cost"))
    return boost.BoostedTrees(list(fv.FEATURES), exact_quantiles(known, [], {"q": ("log_cost", 0.5)}).first()["q"], [])


@query
def leaf_table_score(spark, sf):
    return rounded(boost.predict(prepared(spark, sf), HAND_MODEL).select("project_id", "pred_log"))


@query
def leaf_table_shapley(spark, sf):
    return rounded(drivers.shapley_contributions(prepared(spark, sf), HAND_MODEL, "project_id"))


@query
def oof_median_predictions(spark, sf):
    """Cross-validation with a learner whose model is one number."""
    found = training.cross_validate(prepared(spark, sf), "project_id", median_learner)
    return rounded(found.select("project_id", "fold", "log_cost", "pred_log"))


@query
def oof_median_report(spark, sf):
    return rounded(training.train(prepared(spark, sf), "project_id", median_learner).by_fold)


@query
def quantile_boost_binary(spark, sf):
    """Three rounds on one binary feature, all rows in each."""
    rows = prepared(spark, sf).select("project_id", "is_regional_rail", "log_cost")
    model = boost.fit_quantile_boost(
        rows, "project_id", ["is_regional_rail"], trees=3, learning_rate=0.5, depth=1, subsample=1.0, min_leaf=1
    )
    return rounded(boost.predict(rows, model).select("project_id", "pred_log"))


@query
def quantile_boost_two_features(spark, sf):
    """Two models (rows of even project_id, and all) grown in the same jobs: two rounds on two features."""
    band = F.floor(F.least(F.greatest("log_length", F.lit(3.0)), F.lit(5.0))).cast("double").alias("length_band")
    rows = prepared(spark, sf).filter("log_length IS NOT NULL").select("project_id", "is_regional_rail", band, "log_cost")
    both = rows.withColumn("model", F.explode(F.array(F.lit(0), F.lit(1)))).filter("model = 1 OR project_id % 2 = 0")
    even, every = boost.fit_quantile_models(
        both, "project_id", "model", 2, ["is_regional_rail", "length_band"],
        trees=2, learning_rate=0.5, depth=1, subsample=1.0, min_leaf=1, held_rows=0,
    )
    scored = boost.predict(boost.predict(rows, even, "pred_even"), every, "pred_all")
    return rounded(scored.select("project_id", "pred_even", "pred_all"))


@query
def state_round_trip(spark, sf):
    """A state saved, loaded and used for scoring."""
    projects = stored_projects(spark, sf)
    _, country, city, mean = training.encode_all(prepared(spark, sf, projects))
    medians = features.train_medians(features.training_rows(projects))
    metrics = reuse(evaluate.compute_metrics(predictions(spark, sf, projects)))
    folder = f"{shared_folder(spark)}/states/{uuid.uuid4().hex}"
    save_state(TrainingState(HAND_MODEL, country, city, mean, medians, metrics, metrics), folder, spark)
    scored = scoring.score(src.requests(spark, sf, projects), load_state(spark, folder))
    return rounded(scored.select("request_id", "pred_log", "pred", "total_budget_billions"))


@query
def state_after_broken_save(spark, sf):
    """A save that breaks half-way leaves the state before it, which then scores."""
    projects = stored_projects(spark, sf)
    _, country, city, mean = training.encode_all(prepared(spark, sf, projects))
    medians = features.train_medians(features.training_rows(projects))
    metrics = reuse(evaluate.compute_metrics(predictions(spark, sf, projects)))
    folder = f"{shared_folder(spark)}/states/{uuid.uuid4().hex}"
    save_state(TrainingState(HAND_MODEL, country, city, mean, medians, metrics, metrics), folder, spark)
    zero = country.withColumn("te", F.lit(0.0))
    breaks = metrics.withColumn("r2_log", F.raise_error(F.lit("broken")).cast("double"))
    try:
        save_state(TrainingState(HAND_MODEL, zero, zero, mean, medians, breaks, breaks), folder, spark)
    except PySparkException as error:
        if "broken" not in str(error):
            raise
    scored = scoring.score(src.requests(spark, sf, projects), load_state(spark, folder))
    return rounded(scored.select("request_id", "pred_log", "pred", "total_budget_billions"))


# ---- trained models (no SQL equivalent) --------------------------------------

def _trained(spark, sf, fit, projects) -> TrainingState:
    """Bands and reports are those of the model's own out-of-fold errors."""
    rows = reuse(prepared(spark, sf, projects))
    medians = features.train_medians(features.training_rows(projects))
    return training.train_and_finalize(rows, medians, "project_id", fit)[1]


@query
def quantile_boost_fit_score(spark, sf):
    projects = stored_projects(spark, sf)
    state = _trained(spark, sf, training.quantile_boost(), projects)
    scored = scoring.score(src.requests(spark, sf, projects), state)
    return rounded(scored.select("request_id", "pred_log", "pred", "lo", "hi", "total_budget_billions"))


@query
def gbt_absolute_score(spark, sf):
    rows, *_ = training.encode_all(prepared(spark, sf))
    rows = reuse(rows.select("project_id", *fv.FEATURES, "log_cost"))
    model = boost.fit_absolute_gbt(rows)
    return rounded(boost.predict_gbt(rows, model).select("project_id", "log_cost", "pred_log"))


@query
def oof_boosting_report(spark, sf):
    return rounded(training.train(prepared(spark, sf), "project_id", training.quantile_boost()).metrics)


@query
def tree_shap_drivers(spark, sf):
    projects = stored_projects(spark, sf)
    state = _trained(spark, sf, training.quantile_boost(), projects)
    return rounded(scoring.explain(src.requests(spark, sf, projects), state))
