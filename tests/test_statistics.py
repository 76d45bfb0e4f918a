import numpy as np
import pytest
from pyspark.sql import functions as F

from costweave.operators import encode, evaluate, folds, lookup, quantiles
from costweave.operators.quantiles import exact_quantiles


def skewed_values(spark, n=20_000):
    """Half of the rows in one group, a third of all rows with one equal value, some NULLs."""
    return spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 10 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 11 == 0, F.lit(None))
        .otherwise(F.exp(F.rand(1) * 20)).alias("x"),
        F.rand(2).alias("y"),
    )


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("accuracy", [20, 1000])
def test_narrowed_quantiles_equal_direct_ones(spark, tmp_path, by, accuracy):
    path = str(tmp_path / "t")
    skewed_values(spark).write.parquet(path)
    df = spark.read.parquet(path)
    wanted = {"m": ("x", 0.5), "lo": ("x", 0.1), "hi": ("x", 0.9), "all": ("y", 1.0), "ym": ("y", 0.5)}
    also = {"n": F.count(F.lit(1))}
    direct = exact_quantiles(df, by, wanted, also)
    narrowed = exact_quantiles(df, by, wanted, also, direct_rows=100, accuracy=accuracy)
    key = lambda r: str(r["g"]) if by else ""
    for a, b in zip(sorted(direct.collect(), key=key), sorted(narrowed.collect(), key=key), strict=True):
        assert a.asDict().keys() == b.asDict().keys() and a["n"] == b["n"]
        for alias in wanted:
            assert b[alias] == pytest.approx(a[alias], rel=1e-12)


@pytest.mark.parametrize("accuracy", [20, 1000])
def test_many_quantiles_are_searched_not_tried_one_by_one(spark, tmp_path, monkeypatch, accuracy):
    path = str(tmp_path / "t")
    skewed_values(spark, 6000).withColumn("z", F.when(F.col("y") < 0, F.col("y"))).write.parquet(path)
    df = spark.read.parquet(path)
    wanted = {f"{c}{i}": (c, i / 40) for c in ("x", "y", "z") for i in range(41)}
    direct = exact_quantiles(df, [], wanted).first().asDict()
    looked_up, attach = [], quantiles.attach
    monkeypatch.setattr(quantiles, "attach", lambda rows, *a, **b: looked_up.append(rows.columns) or attach(rows, *a, **b))
    narrowed = exact_quantiles(df, [], wanted, direct_rows=100, accuracy=accuracy).first().asDict()
    assert ["_g", "_c", "_v"] not in looked_up  # before: every value met every bracket of its column
    assert {k: v is None for k, v in narrowed.items()} == {k: k[0] == "z" for k in wanted}
    assert all(narrowed[k] == pytest.approx(direct[k], rel=1e-12) for k in wanted if k[0] != "z")


def test_salted_lookup_equals_broadcast_lookup(spark):
    fact = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
    )
    dim = fact.filter("k IS NOT NULL AND k <> 'k5'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for how in ["left", "inner"]:
        small = lookup.attach(fact, dim, ["k"], how)
        large = lookup.attach(fact, dim, ["k"], how, broadcast_rows=1, hot_key_rows=100)
        assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    plan = large._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_encoder(spark):
    df = spark.createDataFrame(
        [("a", 4.0), ("a", 4.0), (None, -5.0), ("b", None)], "k string, log_cost double"
    )
    got = {r["k"]: r for r in encode.fit_encoder(df, "k", m=10).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["te"] == pytest.approx((8 + 10 * 1.0) / 12) == pytest.approx(1.5) and got["a"]["freq"] == 2
    assert got["b"]["te"] is None and got["b"]["freq"] == 1
    ask = spark.createDataFrame([(1, "a"), (2, "z"), (3, None), (4, "b")], "i int, k string")
    rows = encode.apply_encoder(ask, encode.fit_encoder(df, "k", m=10), encode.global_mean(df), "k").orderBy("i").collect()
    assert [r["k_te"] for r in rows] == pytest.approx([1.5, 1.0, 1.0, 1.0])
    assert [r["k_freq"] for r in rows] == [2, 1, 1, 1]


def test_two_level_fallback_and_context(spark):
    country = spark.createDataFrame([("TR", 2.0, 7)], "country string, te double, freq long")
    city = spark.createDataFrame([("Ankara", 3.0, 4)], "city string, te double, freq long")
    mean = spark.createDataFrame([(1.0,)], "global_mean double")
    ask = spark.createDataFrame(
        [(1, "TR", "Ankara"), (2, "TR", "New"), (3, "XX", "New"), (4, None, None)], "i int, country string, city string"
    )
    rows = encode.two_level_lookup(ask, country, city, mean).orderBy("i").collect()
    assert [r["city_te"] for r in rows] == [3.0, 2.0, 1.0, 1.0]
    assert [r["city_freq"] for r in rows] == [4.0, 1.0, 1.0, 1.0]
    rows = encode.two_level_lookup(ask, country, city, mean, city_fallback="global").orderBy("i").collect()
    assert [r["city_te"] for r in rows] == [3.0, 1.0, 1.0, 1.0]
    rows = encode.market_context(ask, country, city, mean).orderBy("i").collect()
    assert [(r["city_baseline"], r["country_baseline"], r["sample_density"]) for r in rows] == [
        (3.0, 2.0, 4), (2.0, 2.0, 0), (1.0, 1.0, 0), (1.0, 1.0, 0),
    ]


def test_fold_encoders_equal_one_fit_per_fold(spark):
    df = spark.range(300).select(
        "id", F.concat(F.lit("k"), (F.col("id") % 13).cast("string")).alias("k"),
        (F.rand(3) * 4).alias("log_cost"), (F.col("id") % 5).cast("int").alias("fold"),
    ).union(spark.sql("SELECT 999L, 'alone', 2.0D, 3"))
    df = spark.createDataFrame(df.collect(), df.schema)
    table = encode.fold_encoder_table(encode.fit_fold_encoders(df, "k", m=7), "k").collect()
    assert len(table) == 14 * 5
    got = {(r["k"], r["fold"]): (r["te"], r["freq"]) for r in table}
    for fold in range(5):
        outside = df.filter(F.col("fold") != fold)
        mean = outside.agg(F.avg("log_cost")).first()[0]
        single = {r["k"]: r for r in encode.fit_encoder(outside, "k", m=7).collect()}
        for (key, f), (te, freq) in got.items():
            if f != fold:
                continue
            if key in single:
                assert te == pytest.approx(single[key]["te"], rel=1e-12) and freq == single[key]["freq"]
            else:
                assert te == pytest.approx(mean, rel=1e-12) and freq is None
    rows = encode.apply_fold_encoder(df, encode.fit_fold_encoders(df, "k", m=7), encode.fold_global_means(df), "k")
    alone = rows.filter("k = 'alone'").first()
    assert alone["k_freq"] == 1.0 and alone["k_te"] == pytest.approx(got[("alone", 3)][0])


def test_bins_and_folds(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 11)], "id long, log_cost double")
    bins = folds.quantile_bins(df).orderBy("id").collect()
    assert [r["cost_bin"] for r in bins] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    with pytest.raises(ValueError, match="unique"):
        folds.quantile_bins(spark.createDataFrame([(1.0,)] * 5, "log_cost double"))
    many = spark.range(1003).select("id", (F.col("id") % 4).cast("int").alias("cost_bin"))
    folded = folds.stratified_folds(many, "id", max_strata=4)
    assert folded.count() == 1003
    for stratum in range(4):
        sizes = [r["count"] for r in folded.filter(f"cost_bin = {stratum}").groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    again = folds.stratified_folds(many.repartition(7), "id")
    assert sorted(folded.collect()) == sorted(again.select(folded.columns).collect())


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 5.0)], "log_cost double, pred_log double")
    row = evaluate.compute_metrics(df).first()
    errors = np.exp([1.0, 1.0, 2.0]) - 1
    assert row["r2_log"] == pytest.approx(-2.0) and row["rmse_log"] == pytest.approx(np.sqrt(2.0))
    assert row["mdape"] == pytest.approx(np.median(errors) * 100) and row["success_30"] == 0.0
    assert row["q10_multiplier"] == pytest.approx(1 + np.percentile(errors, 10))
    assert row["q90_multiplier"] == pytest.approx(1 + np.percentile(errors, 90))


def test_success_is_strict(spark):
    df = spark.createDataFrame([(0.0, float(np.log(1.5)), 1), (0.0, float(np.log(1.29)), 1)], "log_cost double, pred_log double, fold int")
    assert evaluate.compute_metrics(df).first()["success_30"] == 50.0
    assert evaluate.metrics_by_fold(df).first()["n"] == 2


def test_country_report_needs_three_rows_and_sorts_by_size(spark):
    rows = [("b", 1.0, 1.0)] * 3 + [("a", 1.0, 2.0)] * 3 + [("c", float(i), float(i)) for i in range(4)] + [("d", 1.0, 1.0)] * 2
    df = spark.createDataFrame(rows, "country string, log_cost double, pred_log double")
    report = evaluate.country_report(df).collect()
    assert [(r["country"], r["n"], r["r2_log"]) for r in report] == [("c", 4, 1.0), ("a", 3, 0.0), ("b", 3, 1.0)]
    assert [r["country"] for r in evaluate.report_head(evaluate.country_report(df), 2).collect()] == ["c", "a"]


def test_bands(spark):
    df = spark.createDataFrame([("x", 0.0, 0.0), ("x", 0.0, 0.0), ("y", 0.0, 1.0)], "mode string, log_cost double, pred_log double")
    rows = evaluate.bands_by_mode(df).collect()
    assert [(r["mode"], r["q10_multiplier"], r["q90_multiplier"]) for r in rows] == [("x", 1.0, 1.05)]
    preds = spark.createDataFrame([("x", 10.0), ("z", 10.0)], "mode string, pred double")
    banded = {r["mode"]: (r["lo"], r["hi"]) for r in evaluate.prediction_band(preds, evaluate.bands_by_mode(df), "mode").collect()}
    assert banded == {"x": (10.0, 10.5), "z": (6.5, 14.5)}


def test_reports_leave_out_rows_without_prediction_and_know_constant_truth(spark):
    rows = [("a", 0, 1.0, 1.5), ("a", 0, 2.0, 2.0), ("a", 0, 3.0, 2.5), ("a", 0, 9.0, None), ("b", 1, 2.0, 2.0), ("b", 1, 2.0, 2.0), ("c", 2, 2.0, 2.5), ("c", 2, 2.0, 2.5)]
    df = spark.createDataFrame(rows, "country string, fold int, log_cost double, pred_log double")
    folds_ = {r["fold"]: r for r in evaluate.metrics_by_fold(df).collect()}
    assert folds_[0]["n"] == 3 and folds_[0]["r2_log"] == pytest.approx(1 - 0.5 / 2)
    assert folds_[1]["r2_log"] == 1.0 and folds_[2]["r2_log"] == 0.0
    countries = {r["country"]: r for r in evaluate.country_report(df, min_rows=1).collect()}
    assert countries["a"]["n"] == 3 and countries["a"]["r2_log"] == pytest.approx(0.75)
    assert (countries["b"]["r2_log"], countries["c"]["r2_log"]) == (1.0, 0.0)
    metrics = {r["country"]: r for r in evaluate.compute_metrics(df, ["country"]).collect()}
    assert (metrics["a"]["n"], metrics["b"]["r2_log"], metrics["c"]["r2_log"]) == (3, 1.0, 0.0)


def test_bands_for_all_rows_must_be_one_row(spark):
    bands = spark.createDataFrame([(0.5, 1.5), (0.6, 1.4)], "q10_multiplier double, q90_multiplier double")
    with pytest.raises(ValueError):
        evaluate.prediction_band(spark.createDataFrame([(1.0,)], "pred double"), bands)


def test_folds_keep_null_strata_apart(spark):
    df = spark.createDataFrame([(i, [None, -1, 3][i % 3]) for i in range(60)], "id long, s int")
    got = folds.stratified_folds(df, "id", "s", folds=4).groupBy("s", "fold").count().collect()
    assert len(got) == 12 and {r["count"] for r in got} == {5}


def test_broadcast_bound_counts_array_elements(spark):
    wide = spark.range(10).select("id", F.array_repeat(F.lit(1), 300_000).alias("a"))
    assert not lookup.fits_broadcast(wide) and lookup.fits_broadcast(wide.select("id"))


def test_wide_tables_are_measured_for_a_broadcast(spark):
    plain = spark.range(3).select("id", *[F.lit(1.0).alias(f"c{i}") for i in range(150)])
    assert lookup.fits_broadcast(plain)
    assert plain.agg(F.sum(lookup._cells(plain.schema)).alias("n")).first()["n"] == 3 * 151
