import pytest
from pyspark.sql import functions as F

from costweave import fixed_values as fv
from costweave.operators import boost, similar
from costweave.plans import catalog
from costweave.sources import stand_ins


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A few hundred orders of thirty customers."""
    folder = str(tmp_path_factory.mktemp("orders"))
    i, number = F.col("id"), lambda value: value.cast("double")
    made = {
        "nation": spark.range(3).select(i.alias("n_nationkey"), F.concat(F.lit("NATION"), i).alias("n_name")),
        "customer": spark.range(30).select(
            i.alias("c_custkey"), F.concat(F.lit("c"), i).alias("c_name"), (i % 3).alias("c_nationkey"),
            F.element_at(F.array(F.lit("BUILDING"), F.lit("MACHINERY")), (i % 2 + 1).cast("int")).alias("c_mktsegment"),
        ),
        "part": spark.range(40).select(i.alias("p_partkey"), (i % 8).cast("int").alias("p_size")),
        "orders": spark.range(300).select(
            i.alias("o_orderkey"), (i % 30).alias("o_custkey"), F.when(i % 2 == 0, "F").otherwise("O").alias("o_orderstatus"),
            number(1000 + 37 * i % 911).alias("o_totalprice"), F.date_add(F.lit("1995-01-01"), (i * 5).cast("int")).cast("timestamp").alias("o_orderdate"),
            F.lit("5-LOW").alias("o_orderpriority"),
        ),
        "lineitem": spark.range(900).select(
            (i % 300).alias("l_orderkey"), (i % 40).alias("l_partkey"), number(1 + i % 47).alias("l_quantity"),
            number(100 + i * 13 % 997).alias("l_extendedprice"), F.when(i % 3 == 0, "R").otherwise("N").alias("l_returnflag"),
            F.date_add(F.lit("1996-01-01"), (i % 900).cast("int")).cast("timestamp").alias("l_shipdate"),
        ),
    }
    for name, rows in made.items():
        rows.write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", ["cost_breakdown", "cost_breakdown_interval", "state_after_broken_save", "similar_projects"])
def test_a_query_builds_the_projects_once(spark, tables, monkeypatch, name):
    built, projects = [], stand_ins.projects
    monkeypatch.setattr(stand_ins, "projects", lambda *a: built.append(a) or projects(*a))
    assert catalog.QUERIES[name](spark, tables).count() > 0
    assert len(built) == 1


def test_requests_of_stored_projects_are_the_same(spark, tables):
    stored = catalog.stored_projects(spark, tables)
    assert sorted(map(str, stand_ins.requests(spark, tables, stored).collect())) == sorted(map(str, stand_ins.requests(spark, tables).collect()))


def test_the_search_shuffles_no_texts_of_a_query(spark, tables, monkeypatch):
    reached, descend = [], similar._descend
    monkeypatch.setattr(similar, "_descend", lambda *a: reached.append(descend(*a)) or reached[-1])
    projects = catalog.stored_projects(spark, tables)
    found = similar.similar_projects(stand_ins.requests(spark, tables, projects), projects)
    assert found.count() == 8 * 30
    assert not {"_q", "q_country", "q_city"} & set(reached[0].columns)


def test_the_absolute_gbt_query_grows_all_trees(spark, tables, monkeypatch):
    asked, fit = [], boost.GBTRegressor.fit

    def fit_two(self, df):
        asked.append(self.getMaxIter())
        return fit(self.setMaxIter(2), df)

    monkeypatch.setattr(boost.GBTRegressor, "fit", fit_two)
    assert catalog.QUERIES["gbt_absolute_score"](spark, tables).count() > 0
    assert asked == [fv.TREES]
