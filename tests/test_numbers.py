import pytest
from pyspark.sql import functions as F

from costweave.functions import numbers as num
from costweave.functions.headers import snake_names
from costweave import fixed_values as fv


def apply(spark, function, values, kind):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_slash_numbers(spark):
    cells = ["36/22", "5", "5/x", None, " 7 ", "TBD", "1/2/6", "36/", "1_000"]
    assert apply(spark, num.parse_slash_number, cells, "string") == [29.0, 5.0, None, None, 7.0, None, 3.0, None, None]


def test_plain_numbers_reject_what_only_looks_like_one(spark):
    cells = ["1997", " 1997 ", "1997.5", "1997?", "12d", "0x1p3", "nan", "inf", "-1e3", ".5", "", None]
    expected = [1997.0, 1997.0, 1997.5, None, None, None, None, None, -1000.0, 0.5, None, None]
    assert apply(spark, num.parse_number, cells, "string") == expected


def test_dollars(spark):
    cells = ["$1,234.50", "n/a", " $5 ", "1,000,000", None]
    assert apply(spark, num.parse_dollars, cells, "string") == [1234.5, None, 5.0, 1000000.0, None]


def test_tunnel_share(spark):
    assert apply(spark, num.share_0_1, [80.0, 0.8, 1.0, 1.01, None], "double") == [0.8, 0.8, 1.0, 0.0101, None]


def test_station_density_and_log(spark):
    row = spark.range(1).select(
        num.station_density(F.lit(12.0), F.lit(9.9)).alias("d"),
        num.station_density(F.lit(12.0), F.lit(-0.1)).alias("none"),
        num.safe_log(F.lit(0.0)).alias("log0"),
    ).first()
    assert row["d"] == pytest.approx(1.2) and row["none"] is None and row["log0"] is None


def test_band_guards(spark):
    row = spark.range(1).select(
        num.safe_q10(F.lit(-0.2)).alias("a"), num.safe_q90(F.lit(-0.2), F.lit(0.01)).alias("b")
    ).first()
    assert (row["a"], row["b"]) == (0.0, 0.05)


def test_match_percent_rounds_half_to_even_and_stays_in_range(spark):
    assert apply(spark, num.match_percent, [6.5, 7.0, -1.0, 6.5 * 0.125, 6.5 * 0.625], "double") == [100, 100, 0, 12, 62]


def test_display_text(spark):
    row = spark.range(1).select(
        num.percent_text(F.lit(0.3215)).alias("p"), num.money_text(F.lit(12345.678), 1).alias("m"),
        num.money_range_text(F.lit(1.0), F.lit(2000.0), 0, "M").alias("r"),
        num.signed_percent_text(F.lit(12.34)).alias("s"), num.signed_percent_text(F.lit(-0.5)).alias("t"),
        num.fixed_text(F.lit(12.25), 1).alias("half_even"),
    ).first()
    assert row["p"] == "32.1%" or row["p"] == "32.2%"
    assert row["m"] == "$12,345.7" and row["r"] == "$1M – $2,000M"
    assert (row["s"], row["t"], row["half_even"]) == ("+12.3%", "-0.5%", "12.2")


def test_header_rule():
    headers = [
        "Project\xa0(All costs have been adjusted for inflation in 2021 dollars)", "Mode", "Mode", "locCity",
        "Hard Costs + ROW", "Soft/ Hard Percent", "Tunnel %", "at grade", "Guideway Costs %", "Systems Costs",
    ]
    assert snake_names(headers, fv.SUBSYSTEM_HEADER_EXCEPTIONS) == [
        "project", "mode", "mode_full", "city", "hard_costs_row", "soft_hard_pct", "tunnel_pct", "at_grade_miles",
        "guideway_costs_pct", "systems_costs",
    ]
    assert snake_names(["Mode", "Mode.1"], fv.SUBSYSTEM_HEADER_EXCEPTIONS) == ["mode", "mode_full"]
