"""Block windows against one plain window, under random blocks, gaps, ties and hot spans."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadpulse.operators import series

COLUMNS = ("traffic_lag_1h", "traffic_lag_24h", "traffic_rolling_3h", "traffic_rolling_6h")


def rows(spark, n, seed, same_time=0.0, sensors=3, holes=True):
    rng = random.Random(seed)
    t, out = dt.datetime(2023, 1, 1), []
    for i in range(n):
        if rng.random() >= same_time:
            t += dt.timedelta(minutes=rng.choice([1, 7, 60, 60, 600 if holes else 60, 60 * 24 * 9 if holes else 60]))
        out.append((i, rng.choice([None, *range(sensors)]), t, rng.randrange(0, 7300)))
    rng.shuffle(out)
    return spark.createDataFrame(out, "obs_id long, sensor_id int, date_time timestamp_ntz, traffic_volume int")


def plain(df, keys=()):
    w = Window.partitionBy(*keys).orderBy("date_time", "obs_id")
    v, m = F.col("traffic_volume").cast("double"), F.lit(series.median_value(df, "traffic_volume").first()[0])
    return df.select(
        "obs_id", *[F.coalesce(F.lag(v, k).over(w), m).alias(f"traffic_lag_{k}h") for k in (1, 24)],
        *[F.coalesce(F.avg(v).over(w.rowsBetween(-n, -1)), m).alias(f"traffic_rolling_{n}h") for n in (3, 6)],
    )


def same(got, want):
    pick = ["obs_id", *[F.round(c, 6).alias(c) for c in COLUMNS]]
    a, b = sorted(map(tuple, got.select(*pick).collect())), sorted(map(tuple, want.select(*pick).collect()))
    assert a == b


@pytest.mark.parametrize("seed", range(4))
def test_random_blocks(spark, seed):
    rng = random.Random(seed)
    df = rows(spark, rng.randrange(30, 400), seed, same_time=rng.choice([0.0, 0.5]))
    for keys in ((), ("sensor_id",)):
        same(series.lag_features(df, keys=keys, blocks=rng.choice([1, 2, 3, 16, 100])), plain(df, keys))


def test_blocks_keep_order_and_split_hot_rows(spark):
    """A third of the rows at one instant of one sensor: no block holds more than a few times its share."""
    df = rows(spark, 200, 5).unionByName(
        spark.range(1000, 1100).select(
            F.col("id").alias("obs_id"), F.lit(1).alias("sensor_id"),
            F.lit(dt.datetime(2023, 3, 1)).cast("timestamp_ntz").alias("date_time"),
            F.col("id").cast("int").alias("traffic_volume"),
        )
    )
    blocked = series.with_blocks(df, ("sensor_id",), blocks=16).select("_series", "date_time", "obs_id", "_block")
    assert blocked.groupBy("_block").count().agg(F.max("count")).first()[0] <= 60
    order = Window.partitionBy("_series").orderBy("date_time", "obs_id")
    assert blocked.withColumn("p", F.lag("_block").over(order)).where("p > _block").count() == 0
    same(series.lag_features(df, keys=("sensor_id",), blocks=16), plain(df, ("sensor_id",)))


def test_ten_times_the_rows_have_ten_times_the_blocks(spark):
    """Blocks keep their size: none holds more than twice the mean, whatever the number of map tasks."""
    found = []
    for n in (50_000, 500_000):
        df = spark.range(0, n, 1, 13).select(
            F.col("id").alias("obs_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 50).cast("int").alias("sensor_id"),
            F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.lit(n))).cast("timestamp_ntz").alias("date_time"),
        )
        blocks = series.block_count(n, block_rows=2500, least=1)
        sizes = [r[1] for r in series.with_blocks(df, ("sensor_id",), blocks=blocks).groupBy("_block").count().collect()]
        assert sum(sizes) == n and max(sizes) <= 2 * n / len(sizes)
        found.append((blocks, len(sizes)))
    (few, few_found), (many, many_found) = found
    assert many == 10 * few and abs(few_found - few) <= 4 and abs(many_found - many) <= 20
    assert series.block_count(0) == series.MIN_BLOCKS


def test_fill_and_other_bounds(spark):
    df = rows(spark, 40, 9)
    got = series.lag_features(df, fill=5.0, bounds_from=df.limit(7)).where("traffic_lag_24h = 5.0")
    assert got.count() >= 24
    same(series.lag_features(df, bounds_from=df.limit(0)), plain(df))


def test_offsets_count_rows_not_hours(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, 0), 10), (2, dt.datetime(2024, 3, 1, 0), 20), (3, dt.datetime(2024, 3, 9, 0), 40)],
        "obs_id long, date_time timestamp_ntz, traffic_volume int",
    )
    got = {r.obs_id: (r.traffic_lag_1h, r.traffic_rolling_3h) for r in series.lag_features(df).collect()}
    assert got == {1: (20.0, 20.0), 2: (10.0, 10.0), 3: (20.0, 15.0)}
