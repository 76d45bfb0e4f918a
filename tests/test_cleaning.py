import pytest
from pyspark.sql import functions as F

from costweave import fixed_values as fv
from costweave.functions import headers
from costweave.operators import cleanse, features, normalize
from costweave.sources import tables

RAW = "Country string, City string, Line string, `Start year` string, `End year` string, Length string, " \
      "TunnelPer string, Tunnel string, Stations string, `RR?` double, `Cost/km (2023 dollars)` double, Other string"


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([
        ("TR", "Ankara", "L1", "2001", "2005?", "10", "80", "8", "36/22", 1.0, 100.0, "x"),
        ("TR", None, None, " 1999 ", "2003", "20", "0.5", "dirty", "5", None, 50.0, "x"),
        (None, None, "L3", "2001", "2005", "10", "80", "8", "4", 0.0, 100.0, "x"),
        ("US", "Boston", "L4", "2001", "2005", "10", "80", "8", "4", 0.0, None, "x"),
        ("US", "Boston", "L5", "2001", "2005", "10", None, "8", "4", 0.0, 70.0, "x"),
        ("US", "Boston", "Tozai Line (Sendai)", "2001", "2005", "10", "80", "8", "x/1", 0.0, 70.0, "x"),
    ], RAW)


def test_clean_projects_filters_before_parsing(raw):
    clean = cleanse.clean_projects(raw)
    assert clean.columns[:3] == ["country", "city", "line"] and "Other" not in clean.columns
    rows = {r["line"]: r for r in clean.collect()}
    assert set(rows) == {"L1", None, "Tozai Line (Sendai)"}
    assert rows["L1"]["num_stations"] == 29.0 and rows["L1"]["end_year"] is None
    assert rows[None]["tunnel_km"] is None and rows[None]["start_year"] == 1999.0
    assert rows["Tozai Line (Sendai)"]["num_stations"] is None


def test_quality_reports(raw):
    named = cleanse.rename_known_columns(raw)
    drops = {r["rule"]: r["dropped_rows"] for r in cleanse.row_drop_report(named).collect()}
    assert drops == {"country_and_city_missing": 1, "target_missing": 1, "tunnel_missing": 1}
    nulls = {r["column_name"]: r["new_nulls"] for r in cleanse.new_null_report(named).collect()}
    assert nulls["num_stations"] == 1 and nulls["end_year"] == 1 and nulls["tunnel_km"] == 1
    assert nulls["length_km"] == 0


def test_training_rows_keep_lines_without_a_name(raw):
    clean = cleanse.clean_projects(raw)
    assert {r["line"] for r in features.training_rows(clean).collect()} == {"L1", None}


def test_missing_columns_are_skipped(spark):
    small = spark.createDataFrame([("TR", "5")], "country string, num_stations string")
    assert cleanse.parse_numbers(small).first()["num_stations"] == 5.0
    assert features.base_features(small).columns == small.columns


def test_prepare_training_imputes_before_density_and_after_mid_year(spark):
    rows = spark.createDataFrame([
        ("a", 10.0, 0.5, 4.0, 2000.0, 2002.0, None, 10.0),
        ("b", 9.9, 50.0, None, None, 2002.0, 1.0, 20.0),
        (None, 9.9, 1.0, 8.0, 2004.0, 2006.0, 0.0, 30.0),
    ], f"line string, length_km double, tunnel_pct double, num_stations double, start_year double, end_year double, "
       f"is_regional_rail double, {fv.TARGET} double")
    got = {r["line"]: r for r in features.prepare_training(rows).collect()}
    assert got["b"]["num_stations"] == 6.0 and got["b"]["station_density"] == pytest.approx(0.6)
    assert got["b"]["mid_year"] == 2003.0 and got["b"]["tunnel_pct"] == 0.5
    assert got["a"]["is_regional_rail"] == 0.0 and got[None]["tunnel_pct"] == 1.0


def test_cpi_and_subsystems(spark):
    cpi_raw = spark.createDataFrame(
        [("2021", "271", None, "1", "1.12"), ("2022", "292", None, "1", "1.04"), ("Source: x", None, None, None, None)],
        "A string, B string, C string, D string, E string",
    )
    cpi = normalize.clean_cpi(cpi_raw)
    assert cpi.count() == 2 and normalize.cpi_multiplier(cpi).first()["multiplier"] == 1.12
    with pytest.raises(Exception, match="price index needs one row for 1900"):
        normalize.cpi_multiplier(cpi, 1900).collect()
    raw = spark.createDataFrame(
        [("p", "LRT", 10.0, "$160.934", "$1,000", 1.2), ("q", "HRT", 0.0, "n/a", "$5", 0.4)],
        "`Project\xa0(All costs have been adjusted for inflation in 2021 dollars)` string, Mode string, Length double, "
        "`Cost per Mile` string, `Vehicle Costs` string, `Vehicle Costs %` double",
    )
    rows = {r["project"]: r for r in normalize.clean_subsystems(raw, cpi).collect()}
    p = rows["p"]
    assert p["length_km"] == pytest.approx(16.0934) and p["cost_per_km"] == pytest.approx(100.0)
    assert p["vehicle_costs_per_km"] == pytest.approx(1000 / 16.0934)
    assert p["vehicle_costs_2023"] == pytest.approx(1120) and p["cost_per_km_2023"] == pytest.approx(112)
    assert rows["q"]["vehicle_costs_per_km"] is None and rows["q"]["cost_per_mile"] is None
    renamed = spark.createDataFrame([(1.2,), (None,), (-0.1,), (1.0,)], "vehicle_costs_pct double")
    assert cleanse.share_range_report(renamed).first()["out_of_range"] == 2


def test_sources_round_trip(spark, tmp_path, raw):
    clean = cleanse.clean_projects(raw)
    for name in ["clean.csv", "clean.parquet"]:
        path = str(tmp_path / name)
        tables.write_table(clean, path)
        tables.write_table(clean, path)  # overwrites
        back = tables.read_clean_projects(spark, path)
        key = lambda r: str(r)
        assert sorted(back.select(*clean.columns).collect(), key=key) == sorted(clean.collect(), key=key)
    csv = str(tmp_path / "raw.csv")
    tables.write_table(raw, csv)
    assert dict(tables.read_raw_projects(spark, csv).dtypes)["Stations"] == "string"
    with pytest.raises(FileNotFoundError):
        tables.read_clean(spark, str(tmp_path / "nothing"))
    assert tables.read_similarity_projects(spark, str(tmp_path / "nothing")) is None
    shares = tables.read_similarity_projects(spark, str(tmp_path / "clean.parquet"))
    assert shares.filter(F.col("tunnel_pct") > 1).count() == 0


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, n int")
    assert [r["x"] for r in cleanse.nan_to_null_everywhere(df).orderBy("n").collect()] == [None, 2.0]


def test_repeated_headers_and_missing_words(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('Project,Mode,Year,Mode,,"Cost, total"\nA,LRT,NA,light,x,"$1,200"\nB,N/A,2001,nan,NULL,n/a\n')
    df = tables.read_raw_subsystems(spark, str(path))
    assert df.columns == ["Project", "Mode", "Year", "Mode.1", "Unnamed: 4", "Cost, total"]
    assert [tuple(r) for r in df.collect()] == [("A", "LRT", None, "light", "x", "$1,200"), ("B", None, "2001", None, None, None)]
    kept = tables.read_raw(spark, str(path), missing_words=[])
    assert [r[1] for r in kept.collect()] == ["LRT", "N/A"]
    assert headers.rename_to_snake(df).columns[:4] == ["project", "mode", "year", "mode_1"]
