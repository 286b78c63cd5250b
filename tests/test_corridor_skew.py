"""One corridor and one code hold all conditions, and nothing is broadcast."""

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import corridor

N, SALTS = 20_000, 128


@pytest.fixture
def sorted_joins(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    for name, value in zip(names, ("-1", "false", "4")):
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_hot_corridor_is_dealt_evenly(spark, sorted_joins):
    base = spark.range(N).select(
        F.col("id").alias("scenario_id"), F.lit(0).cast("long").alias("corridor_id"), F.lit(2).alias("base_code"),
        F.lit("x").alias("base_label"), F.lit(None).cast("double").alias("base_confidence"),
    )
    segments = corridor.default_segments(spark)
    state = corridor.corridor_state(base, segments, SALTS)
    assert "BroadcastHashJoin" not in state._jdf.queryExecution().executedPlan().toString()
    per_task = [r["count"] for r in state.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    total = N * segments.count()
    assert sum(per_task) == total and max(per_task) <= 2 * total / 4
    plain = base.join(corridor.coded_segments(segments), ["corridor_id", "base_code"])
    key = ["scenario_id", "ordinal", "name", "segment_code", "segment_label", "color_hex"]
    assert state.select(*key).exceptAll(plain.select(*key)).isEmpty() and state.count() == plain.count()


def test_rows_without_corridor_or_id(spark, sorted_joins):
    base = spark.createDataFrame(
        [(None, 0, 3, "x", None), (1, None, 3, "x", None), (2, 5, 3, "x", None), (2, 0, 3, "x", None), (2, 0, 3, "x", None)],
        "scenario_id long, corridor_id long, base_code int, base_label string, base_confidence double",
    )
    segments = corridor.default_segments(spark)
    n = segments.count()
    counts = corridor.corridor_state(base, segments).groupBy("scenario_id").count().collect()
    assert {r[0]: r[1] for r in counts} == {None: n, 2: 2 * n}
    assert corridor.corridor_summary(base, segments).count() == corridor.alert_block(base, segments).count() == 5
    assert corridor.alert_block(base, segments).where("alert_count = 0").count() == 2
