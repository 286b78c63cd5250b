"""The live report against its parts, with a scorer that has probabilities."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.operators import corridor
from roadpulse.operators.aggregates import LAGS
from roadpulse.operators.scoring import class_probabilities, rule_scorer, score_conditions
from roadpulse.plans.live import live_report


def by_hour(df):
    """The later the hour, the likelier the highest class."""
    top = 0.25 + F.col("hour") / 46
    return df.withColumns({
        "pred_code": F.when(top >= 0.5, 3).otherwise(0),
        "probabilities": F.array(1 - top, F.lit(0.0), F.lit(0.0), top.cast("double")),
    })


@pytest.fixture
def conditions(spark):
    rows = [(i, place, dt.datetime(2024, 5, 7, hour), 18.0, 0.0, 0.0, 40, "Clear", 0, 2500.0) for i, place, hour in ((1, 0, 8), (2, 0, 23), (3, 9, 17), (4, None, 3))]
    return spark.createDataFrame(rows, "scenario_id long, corridor_id long, date_time timestamp_ntz, temp_celsius double, rain_1h double, snow_1h double, clouds_all int, weather_main string, is_holiday int, traffic_lag_1h double")


@pytest.fixture
def lags(spark):
    return spark.range(24).select(F.col("id").cast("int").alias("hour"), *[F.lit(1000.0).alias(c) for c in LAGS])


def test_probabilities_of_now_and_next_hour(spark, conditions, lags):
    told = {r.scenario_id: r for r in live_report(conditions, lags, corridor.default_segments(spark), by_hour).collect()}
    assert len(told) == 4
    for r in told.values():
        for part in (r.current, r.next_hour):
            assert set(part.probabilities) == set(V.CONGESTION_LABELS)
            assert part.probabilities["Severe"] == round(100 * (0.25 + part.hour / 46), 1)
            assert part.confidence == max(part.probabilities.values())
    assert told[2].next_hour.hour == 0 and len(told[1].risk_forecast) == 24
    t = F.col("date_time")
    timed = conditions.withColumns({"hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t), "as_of": F.to_date(t)})
    plain = score_conditions(timed, by_hour).select("scenario_id", class_probabilities(F.col("probabilities")).alias("p")).collect()
    assert {r.scenario_id: r.p for r in plain} == {i: r.current.probabilities for i, r in told.items()}


def test_summary_equals_corridor_summary(spark, conditions, lags):
    segments = corridor.default_segments(spark)
    told = {r.scenario_id: r for r in live_report(conditions, lags, segments, by_hour).collect()}
    base = spark.createDataFrame([(i, c, r.current.code) for (i, c), r in zip(((1, 0), (2, 0), (3, 9), (4, None)), (told[k] for k in (1, 2, 3, 4)))], "scenario_id long, corridor_id long, base_code int")
    names = ("severe_count", "high_count", "total_segments", "worst_segment", "safest_segment")
    want = {r.scenario_id: tuple(r[n] for n in names) for r in corridor.corridor_summary(base, segments).collect()}
    assert want == {i: tuple(r.corridor_summary[n] for n in names) for i, r in told.items()}
    assert want[1][2] == 16 and want[3] == want[4] == (0, 0, 0, None, None)


def test_rules_have_no_probabilities(spark, conditions, lags):
    r = live_report(conditions, lags, corridor.default_segments(spark), rule_scorer()).first()
    assert r.current.probabilities == r.next_hour.probabilities == {} and r.current.confidence is None


def test_texts_are_made_after_the_last_join(spark, sf_dir, monkeypatch):
    """What meets the corridor is numbers: no nested outcome and no narrative is shuffled."""
    from roadpulse.catalog.scenes import _live
    from roadpulse.plans import live

    met, joined = [], live.with_corridor
    monkeypatch.setattr(live, "with_corridor", lambda base, *more: met.append(base.columns) or joined(base, *more))
    _live(spark, sf_dir)
    assert len(met) == 1 and not {"current", "_now", "next_hour", "risk_forecast", "_factors"} & set(met[0])
