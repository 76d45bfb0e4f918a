"""Project, subsystem, price-index and request tables derived from the order tables.

The order tables hold no NULLs and no dirty text, so the dirty tables are rendered here from clean ones.
Every view reads its tables whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave import fixed_values as fv
from costweave.operators.lookup import literal_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clean project per order; the few orders without lines have no length, tunnel or cost."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("length_km"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("tunnel_km"),
        F.count(F.lit(1)).cast("double").alias("num_stations"),
        F.year(F.max("l_shipdate")).alias("ship_year"),
    )
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    year = F.year("o_orderdate")
    return joined.select(
        F.col("o_orderkey").alias("project_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("n_name").alias("country"),
        F.col("c_name").alias("city"),
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("line"),
        F.col("o_orderpriority").alias("mode"),
        "length_km", "tunnel_km",
        F.try_divide(F.col("tunnel_km"), F.col("length_km")).alias("tunnel_pct"),
        "num_stations",
        year.cast("double").alias("start_year"),
        F.greatest(year, F.col("ship_year")).cast("double").alias("end_year"),
        F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0).alias("is_regional_rail"),
        F.col("o_totalprice").alias("total_price"),
        F.try_divide(F.col("o_totalprice"), F.col("length_km")).alias(fv.TARGET),
    )


def raw_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same projects under raw headers, as text, with every kind of dirt; plus an unlisted column."""
    p = projects(spark, sf_dir)
    digit = F.col("project_id") % 10
    whole = lambda c: F.col(c).cast("bigint").cast("string")
    decimals = lambda c, d: F.round(c, d).cast(f"decimal(20,{d})").cast("string")
    stations = (
        F.when(digit == 0, F.concat(whole("num_stations"), F.lit("/"), (F.col("num_stations").cast("bigint") + 2).cast("string")))
        .when(digit == 1, F.concat(whole("num_stations"), F.lit("/x")))
        .when(digit == 2, "TBD")
        .when(digit == 3, F.concat(F.lit(" "), whole("num_stations"), F.lit(" ")))
        .when(digit == 4, F.lit(None))
        .otherwise(whole("num_stations"))
    )
    start = F.when(digit == 5, "1997?").when(digit == 6, " 1997 ").otherwise(whole("start_year"))
    length = F.when(digit == 7, "12d").when(digit == 8, "1_000").otherwise(decimals("length_km", 2))
    share = F.when(F.col("project_id") % 2 == 0, decimals(F.col("tunnel_pct") * 100, 4)).otherwise(decimals("tunnel_pct", 6))
    country = F.when(digit != 9, F.col("country"))
    city = F.when(F.col("project_id") % 100 != 9, F.col("city"))
    return p.select(
        F.col("project_id").alias("Project id"),
        F.col("line").alias("Line"),
        country.alias("Country"), city.alias("City"),
        F.col("mode").alias("Phase"),
        start.alias("Start year"), whole("end_year").alias("End year"),
        F.col("is_regional_rail").alias("RR?"),
        F.when(F.col("length_km").isNotNull(), length).alias("Length"),
        F.when(F.col("tunnel_pct").isNotNull(), share).alias("TunnelPer"),
        F.when(F.col("tunnel_km").isNotNull(), decimals("tunnel_km", 2)).alias("Tunnel"),
        F.when(F.col("num_stations").isNotNull(), stations).alias("Stations"),
        F.when(F.col(fv.TARGET).isNotNull(), decimals(fv.TARGET, 6)).alias("Cost/km (2023 dollars)"),
    )


def subsystems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subsystem cost row per customer with lines: totals per part-size class, shares and lengths."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )
    price, size_class = F.col("l_extendedprice"), F.col("p_size") % 8
    stems = [share.removesuffix("_pct") for share in fv.SUBSYSTEM_SHARES]
    totals = joined.groupBy("o_custkey").agg(
        F.sum("l_quantity").alias("length_miles"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("tunnel_miles"),
        F.round(F.sum(price), 2).alias("project_cost"),
        *[F.round(F.sum(F.when(size_class == i, price)), 2).alias(stem) for i, stem in enumerate(stems)],
    )
    return totals.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("customer_id"),
        F.col("c_name").alias("project"), F.col("c_mktsegment").alias("mode"),
        "length_miles", "tunnel_miles", "project_cost", *stems,
        *[F.try_divide(F.col(stem), F.col("project_cost")).alias(f"{stem}_pct") for stem in stems],
    )


def raw_subsystems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsystem costs under raw headers: dollars as text, every eleventh 'n/a', shares beyond 1 in places."""
    s = subsystems(spark, sf_dir)
    key = F.col("customer_id")
    dollars = lambda c: F.when(key % 11 == 0, "n/a").otherwise(
        F.concat(F.lit("$"), F.format_number(c, 2))
    )
    share = lambda c: F.when(key % 13 == 0, F.col(c) + 1).otherwise(F.col(c))
    per_mile = lambda c: F.round(F.try_divide(F.col(c), F.col("length_miles")), 2)
    return s.select(
        key.alias("Customer id"),
        F.col("project").alias("Project (All costs have been adjusted for inflation in 2021 dollars)"),
        F.col("mode").alias("Mode"),
        F.col("length_miles").alias("Length"),
        F.col("tunnel_miles").alias("Tunnel Miles"),
        dollars("project_cost").alias("Project Cost"),
        dollars(per_mile("project_cost")).alias("Cost per Mile"),
        dollars("soft_costs").alias("Soft Costs"),
        dollars("vehicle_costs").alias("Vehicle Costs"),
        dollars("station_costs").alias("Station Costs"),
        dollars("guideway_costs").alias("Guideway Costs"),
        dollars(per_mile("guideway_costs")).alias("Guideway Costs per Mile"),
        share("soft_costs_pct").alias("Soft Costs %"),
        share("guideway_costs_pct").alias("Guideway Costs %"),
    )


CPI_YEAR = 1997
CPI_BASE_YEAR = 2001


def raw_cpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five columns as in the raw sheet: mean order price per year, indexed to the base year, and a note row."""
    yearly = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("v")
    )
    base = yearly.filter(F.col("y") == CPI_BASE_YEAR).select(F.col("v").alias("b"))
    rows = yearly.crossJoin(F.broadcast(base)).select(
        F.col("y").cast("string").alias("Year"), F.col("v").cast("string").alias("Value"),
        F.lit(None).cast("string").alias("Unnamed"), F.lit(None).cast("string").alias("Older index"),
        (F.col("b") / F.col("v")).cast("string").alias("Index"),
    )
    note = literal_table(
        spark, [("Source note", None, None, None, None)],
        "Year string, Value string, Unnamed string, Older string, Index string",
    ).toDF(*rows.columns)
    return rows.union(note)


def requests(spark: SparkSession, sf_dir: str, built: DataFrame | None = None) -> DataFrame:
    """One scoring request per customer, an average of their orders.

    Some ask for unknown countries or cities, leave out stations, name unknown modes or end too early. `built` is
    the project table, for a caller that has stored it.
    """
    per_customer = (projects(spark, sf_dir) if built is None else built).groupBy("customer_id").agg(
        F.avg("length_km").alias("length_km"),
        F.try_divide(F.sum("tunnel_km"), F.sum("length_km")).alias("tunnel_pct"),
        F.round(F.avg("num_stations"), 0).alias("num_stations"),
        F.min("start_year").alias("start_year"), F.max("end_year").alias("end_year"),
        (F.sum("is_regional_rail") * 2 > F.count("is_regional_rail")).alias("is_regional"),
    )
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("c_custkey")
    return customers.join(per_customer, key == F.col("customer_id"), "left").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        key.alias("request_id"),
        F.when(key % 5 == 1, "NOWHERE").otherwise(F.col("n_name")).alias("country"),
        F.when(key % 3 == 0, "New City").otherwise(F.col("c_name")).alias("city"),
        "length_km", "tunnel_pct",
        F.when(key % 4 == 0, 0.0).otherwise(F.col("num_stations")).alias("num_stations"),
        "start_year",
        F.when(key % 11 == 0, F.col("start_year") - 1).otherwise(F.col("end_year")).alias("end_year"),
        F.coalesce("is_regional", F.lit(False)).alias("is_regional"),
        F.when(key % 7 == 0, "UNKNOWN").otherwise(F.col("c_mktsegment")).alias("transit_mode"),
    )
