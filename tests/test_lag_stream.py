"""Lags from the state of a stream against the batch over all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import series
from roadpulse.streaming.lag_stream import read_observation_stream, run_lag_stream
from tests.test_series import COLUMNS, rows, same


def arrive(spark, tmp_path, parts, **options):
    """Every part is a file of its own and is met by a new start of the query."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        run_lag_stream(read_observation_stream(spark, source, part.schema), out, state, **options).awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("seed", range(2))
def test_equals_batch_over_arrivals_with_restarts(spark, tmp_path, seed):
    """Arrivals follow each other in time; their rows are shuffled, with equal times, sensors without id and gaps."""
    df = rows(spark, 240, seed, same_time=0.3).withColumn("traffic_volume", F.when(F.col("obs_id") % 11 != 3, F.col("traffic_volume"))).cache()
    cuts = [df.where(F.col("obs_id").between(a, a + 59)) for a in range(0, 240, 60)]
    got = arrive(spark, tmp_path, cuts, fill=7.0)
    assert got.where("late").count() == 0
    same(got, series.lag_features(df, keys=("sensor_id",), fill=7.0))


def test_repeats_and_late_rows(spark, tmp_path):
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    part = lambda *r: spark.createDataFrame([(i, 1, h if h is None else hour(h), v) for i, h, v in r], rows(spark, 1, 0).schema)
    got = arrive(spark, tmp_path, [
        part(*[(h, h, 100 + h) for h in range(0, 60, 2)], (0, 0, 100), (99, None, 5)),  # a repeat; a row without time
        part((58, 58, 158), (57, 57, 500), (60, 60, 160)),  # a repeat, a late row, a new one
        part((3, 3, 900), (62, 62, 162)),  # older than all that is kept
        part((58, 58, 158)),  # nothing but a repeat
    ])
    assert got.count() == 30 + 2 + 2 and got.select("obs_id").distinct().count() == 34
    told = {r.obs_id: r for r in got.collect()}
    assert {i for i, r in told.items() if r.late} == {57, 3}
    assert (told[57].traffic_lag_1h, told[57].traffic_rolling_3h) == (156.0, 154.0)
    assert (told[58].traffic_lag_1h, told[60].traffic_lag_1h, told[60].traffic_rolling_3h) == (156.0, 158.0, (156 + 500 + 158) / 3)
    assert [told[3][c] for c in COLUMNS] == [None] * 4
    # 60, 58, 57, 56, 54, ... back to 16
    assert told[62].traffic_lag_1h == 160.0 and told[62].traffic_lag_24h == 116.0


def test_state_is_bounded_and_random_orders_agree(spark, tmp_path):
    """Late rows that come within the kept readings leave the rows after them equal to the batch."""
    rng = random.Random(4)
    df = rows(spark, 120, 8, sensors=1).where("sensor_id IS NOT NULL").cache()
    ids = [r[0] for r in df.select("obs_id").orderBy("obs_id").collect()]
    held = set(rng.sample(ids[20:40], 5))
    first = df.where(F.col("obs_id").isin([i for i in ids[:40] if i not in held]))
    second = df.where(F.col("obs_id").isin([*held, *ids[40:]]))
    got = arrive(spark, tmp_path, [first, second], fill=1.0).cache()
    assert {r[0] for r in got.where("late").select("obs_id").collect()} == {i for i in held if i < max(set(ids[:40]) - held)}
    want = series.lag_features(df, keys=("sensor_id",), fill=1.0)
    after = F.col("obs_id") >= ids[40]
    same(got.where(after), want.where(after))
