import os

from costweave.operators.boost import BoostedTrees
from costweave.sources.state import TrainingState
from costweave.streaming.scoring import score_stream
from costweave import fixed_values as fv
from costweave.session import reuse, shared_folder, stored_tables

REQUESTS = (
    "request_id long, country string, city string, length_km double, tunnel_pct double, num_stations int, "
    "start_year int, end_year int, is_regional boolean, transit_mode string"
)


def test_stream_scores_each_valid_request_once(spark, tmp_path):
    state = TrainingState(
        BoostedTrees(list(fv.FEATURES), 1.0, [(0, 0, 0.5, 1.0, [])]),
        spark.sql("SELECT 'A' AS country, 2.0D AS te, 3L AS freq"), spark.sql("SELECT 'x' AS city, 2.0D AS te, 3L AS freq"),
        spark.sql("SELECT 1.5D AS global_mean"), spark.sql("SELECT 9.0D AS num_stations, 2000.0D AS mid_year"), None, None,
    )
    asks = [(i, "A", "x", 10.0, 0.5, 4, 2000, 1999 if i == 3 else 2004, False, "LRT") for i in range(5)]
    spark.createDataFrame(asks, REQUESTS).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = score_stream(stream, state, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["request_id"] for r in rows) == [0, 1, 2, 4]
    assert {r["pred_log"] for r in rows} == {1.5} and all(r["lo"] < r["pred"] < r["hi"] for r in rows)


def test_stored_tables_go_with_their_scope(spark):
    folder = shared_folder(spark).removeprefix("file:")
    kept = reuse(spark.range(3))
    before = set(os.listdir(f"{folder}/tables"))
    with stored_tables(spark):
        assert reuse(spark.range(5)).count() == 5
        assert len(os.listdir(f"{folder}/tables")) == len(before) + 1
    assert set(os.listdir(f"{folder}/tables")) == before and kept.count() == 3
