"""Tables dealt by size, and what counts frames by key."""

from pyspark.sql import functions as F

from trackwise import probes
from trackwise.operators import posterior


def test_candidates_take_more_tasks_as_tables_grow(spark, tmp_path, monkeypatch):
    sf = "/root/testdata/sf0.001"
    key = ["scenario", "sample_id", "possible_goal"]
    rows = lambda: sorted(map(tuple, probes.cand(spark, sf).collect()))
    want = rows()
    monkeypatch.setattr(probes, "TASK_ROWS", 300)
    assert rows() == want
    n = probes.cand(spark, sf).select(*key, F.spark_partition_id().alias("p")).groupBy("p").count()
    assert n.count() > 15 and n.agg(F.max("count")).first()[0] < 600


def test_low_samples_count_distinct_known_frames(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("b", None), ("c", 1), ("c", None), ("d", None), (None, 1), (None, 2)], "k string, f int")
    got = posterior.drop_low_samples(rows, ["k"], "f")
    assert sorted(map(tuple, got.collect()), key=str) == [("b", 1), ("b", 2), ("b", None)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
