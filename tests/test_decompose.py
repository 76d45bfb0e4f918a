import pytest

from costweave import fixed_values as fv
from costweave.operators import decompose

COLUMNS = "mode string, " + ", ".join(f"{c} double" for c in decompose.SHARES)


@pytest.fixture(scope="module")
def ratios(spark):
    rows = [("LRT", *[0.1 * (i + 1) for i in range(8)])] * 5
    rows += [("HRT", 0.4, 0.4, None, 0.0, 0.0, 0.0, 0.0, 0.0)] * 2
    rows += [("ZERO", *[0.0] * 8), ("NONE", *[None] * 8), ("Trolley", 1.0, *[0.0] * 7), (None, *[0.3] * 8)]
    return decompose.subsystem_ratios(spark.createDataFrame(rows, COLUMNS)).cache()


def of(ratios, mode):
    return ratios.filter("is_global").first() if mode is None else ratios.filter(f"mode = '{mode}'").first()


def test_ratios(ratios):
    assert ratios.count() == 6
    lrt = of(ratios, "LRT")
    assert sum(lrt[c] for c in decompose.SHARES) == pytest.approx(1.0)
    assert lrt["guideway_costs_pct"] == pytest.approx(1 / 36) and not lrt["low_n"]
    hrt = of(ratios, "HRT")
    assert hrt["systems_costs_pct"] is None and hrt["guideway_costs_pct"] == pytest.approx(0.5) and hrt["low_n"]
    for mode in ["ZERO", "NONE"]:
        assert [of(ratios, mode)[c] for c in decompose.SHARES] == [0.125] * 8
    trolley, whole = of(ratios, "Trolley"), of(ratios, None)
    assert trolley["forced_global"] and [trolley[c] for c in decompose.SHARES] == [whole[c] for c in decompose.SHARES]
    assert trolley["n_projects"] == 1 and whole["n_projects"] == 11


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="sitework_costs_pct"):
        decompose.subsystem_ratios(spark.createDataFrame([("a", 1.0)], "mode string, guideway_costs_pct double"))


def test_variability(ratios):
    got = {r["mode"]: r["variability"] for r in decompose.mode_variability(ratios).filter("NOT is_global").collect()}
    assert got["ZERO"] == 0.0 and 0 < got["LRT"] < 1


def test_breakdown(spark, ratios):
    scored = spark.createDataFrame([(1, "LRT", 36.0, 2.0), (2, "XYZ", 10.0, 1.0)], "request_id int, transit_mode string, pred double, length_km double")
    point = decompose.breakdown(scored, ratios).filter("request_id = 1").orderBy("ordinal").collect()
    assert [r["point"] for r in point] == pytest.approx([1, 2, 3, 4, 5, 6, 7, 8])
    assert [r["subsystem"] for r in point] == decompose.LABELS
    bands = spark.createDataFrame([(-0.2, 0.01)], "q10_multiplier double, q90_multiplier double")
    rows = decompose.breakdown_interval(scored, ratios, bands)
    first = rows.filter("request_id = 1 AND ordinal = 0").first()
    assert (first["lo"], first["hi"]) == pytest.approx((0.0, 0.05)) and not first["fallback_used"]
    unknown = rows.filter("request_id = 2").collect()
    assert {r["n_projects"] for r in unknown} == {0} and all(r["fallback_used"] for r in unknown)
    assert sum(r["point"] for r in unknown) == pytest.approx(10.0)
    report = decompose.breakdown_report(rows).filter("request_id = 1 AND ordinal = 7").first()
    assert report["ratio"] == pytest.approx(8 / 36) and report["total_point"] == pytest.approx(16.0)


def test_default_ratios_and_mode(spark, ratios):
    scored = spark.createDataFrame([(1, 100.0)], "request_id int, pred double")
    rows = {r["subsystem"]: r for r in decompose.breakdown_interval(scored, None).collect()}
    assert {k: r["point"] for k, r in rows.items()} == pytest.approx({k: 100 * v for k, v in fv.DEFAULT_RATIOS.items()})
    assert rows["Guideway"]["lo"] == pytest.approx(20.8) and rows["Guideway"]["hi"] == pytest.approx(46.4)
    assert {r["transit_mode"] for r in decompose.breakdown_interval(scored, ratios).collect()} == {"HRT"}
