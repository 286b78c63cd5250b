"""Bucket edges, ties, rounding bases and texts on small literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.functions import columns as C
from roadpulse.operators import aggregates as A
from roadpulse.operators import cleaning, corridor, explain, features, ranking
from roadpulse.operators.scoring import rule_scorer, score_conditions, score_now, with_prediction

OBS = (
    "obs_id long, date_time timestamp_ntz, traffic_volume int, temp double, rain_1h double, snow_1h double, "
    "clouds_all int, weather_main string, holiday string"
)


def obs(spark, rows):
    """rows: (obs_id, time, volume[, overrides])"""
    out = []
    for r in rows:
        extra = r[3] if len(r) > 3 else {}
        base = dict(temp=280.0, rain_1h=0.0, snow_1h=0.0, clouds_all=40, weather_main="Clear", holiday=None)
        base.update(extra)
        out.append((r[0], r[1], r[2], *base.values()))
    return spark.createDataFrame(out, OBS)


def at(day, hour):
    return dt.datetime(2024, 1, day, hour)


def prepare(df):
    return (
        df.transform(cleaning.clean).transform(features.row_features)
        .transform(features.label_congestion).transform(cleaning.drop_unlabelled)
    )


def column(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_congestion_edges(spark):
    values = [-1.0, -0.0005, 0.0, 1000.0, 1000.5, 1001.0, 2500.0, 4500.0, 7300.0, 7301.0, None]
    assert column(spark, values, C.congestion_code) == [None, None, 0, 0, 1, 1, 1, 2, 3, None, None]
    assert column(spark, values, C.nearest_code) == [0, 0, 0, 0, 1, 1, 1, 2, 3, 3, None]


def test_bins_are_a_parameter(spark):
    assert column(spark, [5.0, 11.0, 99.0], lambda x: C.congestion_code(x, (0, 5, 10, 20, 30))) == [0, 2, None]


def test_rain_edges_differ_between_history_and_serving(spark):
    values = [0.0, 0.1, 2.5, 7.6, 50.0]
    assert column(spark, values, C.rain_level) == [0, 1, 1, 2, 3]
    assert column(spark, values, lambda x: C.rain_level(x, "serve")) == [0, 1, 2, 3, 3]
    with pytest.raises(ValueError):
        C.rain_level(F.lit(1.0), "other")


def test_segment_cut_follows_the_code(spark):
    assert column(spark, [0.70, 0.49, 1.5, 2.5], lambda f: C.segment_code(F.lit(1), f)) == [1, 0, 2, 3]


def test_risk_scores(spark):
    assert column(spark, [0, 1, 2, 3], C.risk_score, "int") == [0.0, 33.3, 66.7, 100.0]


def test_unknown_weather_and_levels(spark):
    assert column(spark, ["Clear", "Tornado", None], C.weather_code, "string") == [0.0, 2.0, 2.0]
    assert column(spark, ["Extreme", "Severe"], lambda x: explain.urgency(x, "agent"), "string") == ["LOW", "CRITICAL"]
    assert column(spark, ["Extreme", "Severe"], lambda x: explain.urgency(x, "tool"), "string") == ["NORMAL", "CRITICAL"]


def test_duplicates_with_nulls_and_median_repair(spark):
    rows = [
        (1, at(1, 5), 100, {"temp": 0.0}), (1, at(1, 5), 100, {"temp": 0.0}),
        (2, at(2, 5), 100, {"temp": 270.0}), (3, at(3, 5), 100, {"temp": 280.0}), (4, at(1, 6), 100, {"temp": 0.0}),
    ]
    got = {r.obs_id: r.temp for r in cleaning.clean(obs(spark, rows)).collect()}
    # The hour's median includes the zero itself: median(0, 270, 280).
    assert got == {1: 270.0, 2: 270.0, 3: 280.0, 4: 0.0}


def test_cap_keeps_null(spark):
    df = spark.createDataFrame([(60.0,), (None,), (50.0,)], "rain_1h double")
    assert [r[0] for r in cleaning.cap(df).collect()] == [50.0, None, 50.0]


def test_ties_take_the_first_key(spark):
    df = prepare(obs(spark, [(1, at(1, 4), 500), (2, at(1, 9), 500), (3, at(2, 4), 500)]))
    peak = A.peak_summary(df).first()
    assert (peak.peak_hour, peak.trough_hour, peak.peak_day) == (4, 4, "Mon")
    assert ranking.ranked(df.select("obs_id", "traffic_volume"), "traffic_volume", "obs_id").first().obs_id == 1


def test_no_holidays_give_zero_and_weather_finding_needs_weather(spark):
    df = prepare(obs(spark, [(1, at(1, 4), 500, {"weather_main": None}), (2, at(6, 9), 700, {"weather_main": None})]))
    peak = A.peak_summary(df)
    assert peak.first().holiday_avg == 0.0
    assert explain.findings_from_peak(peak).count() == 5


def test_rush_premium_divisor_is_floored(spark):
    df = prepare(obs(spark, [(1, at(6, 8), 1000), (2, at(6, 3), 0)]))  # Saturday only
    r = A.weekday_weekend(df).first()
    assert r.weekday_avg is None and r.peak_weekday_hour is None and r.peak_weekend_hour == 8


def test_severity_profile_keeps_empty_labels(spark):
    df = prepare(obs(spark, [(1, at(1, 4), 500)]))
    assert [(r.severity_label, r.avg_volume) for r in A.severity_profile(df).orderBy("severity").collect()] == [
        ("Clear/Dry", 500.0), ("Light Rain", None), ("Moderate Rain", None), ("Heavy Rain", None), ("Snow/Severe", None)
    ]


def test_month_comparison_fills_zero(spark):
    rows = A.weekday_weekend_by_month(prepare(obs(spark, [(1, at(1, 4), 500)]))).orderBy("month").collect()
    assert len(rows) == 12 and rows[0].weekday_avg == 500.0 and rows[0].weekend_avg == 0.0 and rows[11].weekday_avg == 0.0


def test_temperature_bins_are_right_closed(spark):
    kelvin = [243.15, 248.15, 248.20, 313.15, 320.0]
    df = prepare(obs(spark, [(i, at(1, i), 100 * (i + 1), {"temp": t}) for i, t in enumerate(kelvin)]))
    got = {r.temp_bin for r in A.temperature_profile(df.withColumn("temp_celsius", F.round("temp_celsius", 6))).collect()}
    assert got == {"(-30, -25]", "(-25, -20]", "(35, 40]"}


def test_iso_week_of_the_last_day(spark):
    df = prepare(obs(spark, [(1, dt.datetime(2018, 12, 31, 1), 10), (2, dt.datetime(2018, 6, 1, 1), 10)]))
    assert {(r.year, r.week_of_year) for r in A.daily_calendar(df).collect()} == {(2018, 1), (2018, 22)}


def test_default_year_counts_days_and_prefers_the_smaller(spark):
    rows = [(1, dt.datetime(2019, 1, 1, 1), 10), (2, dt.datetime(2019, 1, 1, 2), 10), (3, dt.datetime(2018, 1, 1, 1), 10)]
    assert [r.year for r in A.daily_calendar(prepare(obs(spark, rows))).collect()] == [2018]


def test_weather_gap_falls_back_to_the_minimum(spark):
    df = prepare(obs(spark, [(1, at(1, 1), 900), (2, at(1, 2), 300, {"weather_main": "Rain"})]))
    r = A.weather_extremes(df).first()
    assert (r.best_weather, r.worst_weather, r.clear_gap) == ("Clear", "Rain", 600)


def test_distribution_is_zero_filled_and_sums_to_100(spark, sf_dir):
    from roadpulse.catalog.history import lean

    df = lean(spark, sf_dir)
    assert abs(sum(r.pct for r in A.class_distribution(df).collect()) - 100) < 0.3
    for r in A.class_share_by_hour(df).collect():
        assert abs(r.low + r.medium + r.high + r.severe - 100) < 1e-3
    empty = A.class_distribution(df.where("obs_id < 0")).collect()
    assert [r.n for r in empty] == [0, 0, 0, 0]


# --- the worked example -----------------------------------------------------------------

COND = (
    "scenario_id long, corridor_id long, as_of date, hour int, day_of_week int, month int, temp_celsius double, "
    "rain_1h double, traffic_lag_1h double, traffic_lag_24h double, traffic_rolling_3h double, traffic_rolling_6h double"
)


def evening(spark):
    return spark.createDataFrame(
        [(1, 0, dt.date(2026, 8, 17), 17, 1, 8, 18.0, 0.0, 5200.0, 4000.0, 4800.0, 4500.0)], COND
    )


def test_worked_example(spark):
    r = explain.predict_explain_plan(evening(spark), rule_scorer()).first()
    assert (r.label, r.pred_code, r.confidence, r.class_probabilities) == ("Severe", 3, None, {})
    assert [(f.factor, f.impact) for f in r.factors] == [
        ("Evening rush hour (17:00)", "high"), ("Weekday (Tuesday)", "moderate"),
        ("Prior hour also heavy (5,200 vehicles)", "high"),
    ]
    assert r.narrative == (
        "Severe congestion — gridlock possible. Primary drivers: Evening rush hour (17:00), "
        "Prior hour also heavy (5,200 vehicles). Travel times may double. Avoid if possible."
    )
    assert r.urgency == "CRITICAL" and len(r.immediate_actions) == 5
    assert r.contextual_actions == [V.CONTEXT_ACTIONS["agent"]["rush"]]
    assert (r.rush_type, r.year, r.day_of_year, r.clouds_all, r.weather_code) == (2, 2026, 229, 40, 0.0)
    assert round(r.hour_sin, 3) == -0.966 and round(r.month_cos, 3) == -0.5


def test_feature_row_is_complete(spark):
    assert set(V.FEATURES) <= set(features.condition_features(evening(spark)).columns)
    assert len(V.FEATURES) == 27


def test_confidence_rules_per_variant(spark):
    def scored(p):
        def scorer(df):
            return df.withColumns({"pred_code": F.lit(0), "probabilities": F.array(*[F.lit(x) for x in p])})
        return score_conditions(evening(spark), scorer)

    unsure = scored([0.55, 0.2, 0.2, 0.05])
    assert unsure.first().confidence == 55.0
    for variant in ("agent", "tool", "panel"):
        assert explain.plan_actions(unsure, variant).first().contextual_actions == [V.CONTEXT_ACTIONS[variant]["confidence"]]
    zero = scored([0.0, 0.5, 0.5, 0.0])
    assert explain.plan_actions(zero, "agent").first().contextual_actions == []
    assert len(explain.plan_actions(zero, "tool").first().contextual_actions) == 1


def test_tool_variant_asks_for_police(spark):
    r = explain.plan_actions(score_conditions(evening(spark), rule_scorer()), "tool").first()
    assert r.contextual_actions == [V.CONTEXT_ACTIONS["tool"][k] for k in ("rush", "police")]


def test_unknown_level_description(spark):
    r = explain.describe_levels(spark.createDataFrame([("Odd",)], "level string")).first()
    assert r.error == "Unknown level 'Odd'. Use: Low, Medium, High, Severe." and r.summary is None


def test_score_now_reads_the_given_time(spark):
    df = evening(spark).drop("hour", "day_of_week", "month", "as_of").withColumn(
        "date_time", F.lit(dt.datetime(2024, 2, 29, 23, 5, 7)).cast("timestamp_ntz")
    )
    r = score_now(df, rule_scorer()).first()
    assert (r.local_time, r.day_name, r.date, r.day_of_year) == ("23:05", "Thursday", "2024-02-29", 60)


# --- corridor ---------------------------------------------------------------------------

def test_worst_and_safest_segment_ties(spark):
    seg = spark.createDataFrame(
        [(0, 0, "a", "e", 0.9, [[1.0, 2.0]]), (0, 1, "b", "e", 1.0, [[1.0, 2.0]]), (0, 2, "c", "e", 1.0, [[1.0, 2.0]])],
        corridor.SEGMENT,
    )
    base = corridor.base_predictions(evening(spark).withColumn("traffic_lag_1h", F.lit(1500.0)), rule_scorer())
    r = corridor.corridor_summary(base, seg).first()
    assert (r.worst_segment, r.safest_segment, r.total_segments) == ("b", "b", 3)


def test_default_corridor(spark):
    seg = corridor.default_segments(spark)
    assert seg.count() == 16
    meta = corridor.segment_metadata(seg).orderBy("ordinal").collect()
    assert (meta[4].factor, meta[4].is_bottleneck, meta[0].lat_center, meta[0].lon_center) == (1.5, True, 44.965, -93.42)
    assert [r.factor for r in corridor.segments_by_factor(seg).limit(2).collect()] == [1.5, 1.4]
    base = corridor.base_predictions(evening(spark), rule_scorer())
    state = corridor.corridor_state(base, seg)
    below = {r.factor for r in state.where("segment_code < 3").collect()}
    assert state.count() == 16 and below == {0.70, 0.75, 0.80}  # 3 x factor stays under 2.5
    assert corridor.bottlenecks(state, "Severe").count() == 13


def test_segment_lookup_prefers_equal_then_first_part(spark):
    seg = spark.createDataFrame(
        [(0, 0, "North Bridge", "e", 1.0, [[1.0, 2.0]]), (0, 1, "Bridge", "e", 1.2, [[1.0, 2.0]])], corridor.SEGMENT
    )
    asks = spark.createDataFrame([(1, 0, "bridge"), (2, 0, "BRIDG"), (3, 0, "x"), (4, 0, None)], "scenario_id long, corridor_id long, segment_query string")
    got = {r.scenario_id: (r.segment_name, r.error) for r in corridor.find_segments(asks, seg).collect()}
    assert got[1] == ("Bridge", None) and got[2] == ("North Bridge", None)
    assert got[3] == (None, "Segment 'x' not found.") and got[4][0] is None


def test_report_texts(spark):
    df = evening(spark).withColumns({"temp_celsius": F.lit(0.5), "rain_1h": F.lit(2.55), "is_holiday": F.lit(1)})
    r = explain.congestion_report(df, rule_scorer(), "Ring 100%").first()
    assert r.headline == "🔴 Ring 100% Traffic Alert — Severe congestion predicted at 17:00 on Tuesday, Aug"
    assert r.conditions_summary.endswith("Holiday · Rush hour · 0°C")
    assert r.contextual_actions == list(V.CONTEXT_ACTIONS["report"].values())


def test_prediction_of_a_vector(spark):
    def scorer(df):
        return df.withColumns({"pred_code": F.lit(2), "probabilities": F.array(*[F.lit(x) for x in (0.1, 0.2, 0.612, 0.088)])})

    r = with_prediction(spark.range(1), scorer).first()
    assert (r.label, r.confidence) == ("High", 61.2)


def test_printed_decimals_round_the_exact_value(spark):
    from roadpulse.functions.columns import fixed

    values = [0.0, 0.05, 0.1, 0.15, 0.125, 0.25, 0.35, 0.45, 0.375, 0.95, 0.99, 0.995, 2.25, 2.5, 2.35, 7.6, 7.65, 49.95, 50.0, 1234.565, 1e-9]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed(F.col("v"), 1).alias("a"), fixed(F.col("v"), 2).alias("b"))
    assert all((r.a, r.b) == (f"{r.v:.1f}", f"{r.v:.2f}") for r in got.collect())
