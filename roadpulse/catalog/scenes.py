"""Queries over scored conditions, corridors, explanations and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.catalog.base_sql import case, day_long, label, month_short, segment, sql, text
from roadpulse.catalog.history import history, lean, rounded
from roadpulse.functions import columns as C
from roadpulse.operators import aggregates as A
from roadpulse.operators import corridor as K
from roadpulse.operators import explain as X
from roadpulse.operators import features
from roadpulse.operators import scoring as S
from roadpulse.plans.live import live_report
from roadpulse.session import scratch_path
from roadpulse.sources import bindings as B
from roadpulse.streaming.scoring_stream import corridor_alerts, read_condition_stream, run_alert_stream
from roadpulse.schema import CONDITIONS

RULE = S.rule_scorer()
PLACE = "Example Corridor"
ARRIVING_ROWS = 500_000  # conditions of an arriving file


def _lags(spark, d):
    return history(spark, d).transform(A.median_lags_by_hour).transform(A.complete_hours)


def _risk(spark, d):
    return S.risk_by_hour(B.conditions(spark, d), _lags(spark, d), RULE)


def _base(spark, d):
    return K.base_predictions(B.conditions(spark, d), RULE)


def _state(spark, d):
    return K.corridor_state(_base(spark, d), B.segments(spark, d))


def _joined(column, sep="|"):
    return F.array_join(column, sep)


def _pred(spark, d):
    return S.score_conditions(B.conditions(spark, d), RULE)


def _asks(spark, d):
    """Every condition asks for a segment: by exact name in odd case, by a part of a name, or for
    one that does not exist."""
    i = F.col("scenario_id") % 3
    number = F.format_string("%09d", F.col("corridor_id") * 16 + F.col("scenario_id") % 8)
    q = F.when(i == 0, F.concat(F.lit("SUPPLIER#"), number)).when(i == 1, F.substring(number, 8, 2)).otherwise("no such place")
    return B.conditions(spark, d).withColumn("segment_query", q)


def _levels(spark, d):
    """Levels asked for by the observations: their own class, or an unknown one."""
    df = lean(spark, d)
    return df.select("obs_id", F.when(F.col("obs_id") % 5 == 0, "Extreme").otherwise(F.col("congestion_label")).alias("level"))


def _hourly_rule(df):
    """A rule that depends on the hour, so that outlooks rise, fall and stay."""
    shift = F.floor(F.col("hour") / 2).cast("int") % 3
    return RULE(df).withColumn("pred_code", ((F.col("pred_code") + shift) % 4).cast("int"))


_hourly_rule.has_probabilities = False


def _live(spark, d):
    r = live_report(B.conditions(spark, d), _lags(spark, d), B.segments(spark, d), RULE)
    return r.select(
        "scenario_id", "timestamp", "local_time", "date", "day_name",
        F.col("current.label").alias("label"), F.col("current.code").alias("code"),
        F.col("next_hour.hour").alias("next_hour"), F.col("next_hour.label").alias("next_label"), "trend",
        _joined(F.transform("risk_forecast", lambda x: x["code"].cast("string")), "").alias("risk_codes"),
        _joined(F.transform("corridor", lambda x: x["segment_code"].cast("string")), "").alias("corridor_codes"),
        F.col("alerts.alert_count").alias("alert_count"), F.col("alerts.alert_active").alias("alert_active"),
        "corridor_summary.*",
    )


def _text_block(df, *extra):
    return df.select(
        "scenario_id", "label", *extra,
        _joined(F.transform("factors", lambda f: F.concat_ws("/", f["factor"], f["impact"], f["detail"]))).alias("factors"),
    )


def _plan(spark, d, variant):
    p = _pred(spark, d).transform(X.plan_actions, variant)
    return p.select("scenario_id", _joined("contextual_actions").alias("actions"), "urgency")


def _stream(spark, d):
    """Conditions written as files of bounded size, scored as a stream to completion, two files at a time, read back."""
    source, out, state = (scratch_path(spark, n) for n in ("conditions", "alerts", "alert-state"))
    have = B.conditions(spark, d)
    full = have.select(*[
        F.col(f.name).cast(f.dataType) if f.name in have.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in CONDITIONS.fields
    ])
    full.repartition(max(4, -(-full.count() // ARRIVING_ROWS))).write.parquet(source)
    q = run_alert_stream(read_condition_stream(spark, source, 2), B.segments(spark, d), RULE, out, state, salts=1)
    q.awaitTermination()
    return spark.read.parquet(out).select("scenario_id", "name", "segment_label", "segment_code")


STATE_COLUMNS = (
    "scenario_id", "corridor_id", "base_code", "base_label", "ordinal", "name", "exit", "factor", "lat_center",
    "lon_center", "is_bottleneck", "segment_code", "segment_label", "color_hex",
)

QUERIES = {
    "j3_scenario_hours": lambda s, d: S.score_hours(B.conditions(s, d), RULE, list(range(24))).select(
        "scenario_id", "hour", "rush_type"),
    "j4_scenario_segments": lambda s, d: _state(s, d).select("scenario_id", "ordinal", "factor"),
    "g1_risk_by_hour": lambda s, d: _risk(s, d).select(
        "scenario_id", "hour", "label", F.col("pred_code").alias("code"), "risk_score"),
    "g2_risk_summary": lambda s, d: _risk(s, d).transform(S.risk_summary).select(
        "scenario_id", "peak_hour", "avg_risk", _joined("severe_hours").alias("severe_hours"),
        _joined("high_hours").alias("high_hours")),
    "g3_score_conditions": lambda s, d: _text_block(
        _pred(s, d).transform(X.explain), "pred_code", "confidence", "narrative", "is_rush_hour", "is_weekend"),
    "g4_score_hours": lambda s, d: S.score_hours(
        B.conditions(s, d).withColumn("hours", F.array(F.lit(17), F.lit(8), F.pmod(F.col("hour") + 5, F.lit(24)))), RULE
    ).select("scenario_id", "position", "hour", "label", F.col("pred_code").alias("code")),
    "g5_feature_vector": lambda s, d: B.conditions(s, d).transform(features.condition_features).select(
        "scenario_id", *[F.round(F.col(f).cast("double"), 6).alias(f) for f in V.FEATURES]),
    "g6_score_now": lambda s, d: S.score_now(B.conditions(s, d), RULE).select(
        "scenario_id", "hour", "label", "timestamp", "local_time", "day_name", "date"),
    "g7_segment_code": lambda s, d: _pred(s, d).select(
        "scenario_id", *[C.segment_code(F.col("pred_code"), F.lit(f)).alias(f"at_{int(f * 100)}") for f in (0.7, 1.0, 1.5)]),
    "g8_corridor_state": lambda s, d: _state(s, d).select(*STATE_COLUMNS),
    "g9_corridor_summary": lambda s, d: K.corridor_summary(_base(s, d), B.segments(s, d)).select(
        "scenario_id", "severe_count", "high_count", "total_segments", "worst_segment", "safest_segment"),
    "g10_bottlenecks": lambda s, d: K.bottlenecks(_state(s, d)).select("scenario_id", "name", "segment_code"),
    "g10_bottlenecks_short": lambda s, d: K.bottlenecks(_state(s, d), "Severe", short=True),
    "g10_unknown_level": lambda s, d: K.bottlenecks(_state(s, d), "Extreme", short=True),
    "g11_find_segments": lambda s, d: K.find_segments(_asks(s, d), B.segments(s, d)).select(
        "scenario_id", "segment_query", "segment_name", "segment_factor", "error"),
    "g12_segment_history": lambda s, d: K.segment_history(_asks(s, d), B.segments(s, d), RULE),
    "g12_history_summary": lambda s, d: K.segment_history(_asks(s, d), B.segments(s, d), RULE)
    .transform(K.segment_history_summary).withColumn("safe_hours", _joined("safe_hours")),
    "g13_segment_metadata": lambda s, d: B.segments(s, d).transform(K.segment_metadata),
    "g14_segment_list": lambda s, d: B.segments(s, d).transform(K.segment_list),
    "g15_segments_by_factor": lambda s, d: B.segments(s, d).transform(K.segments_by_factor),
    "g16_next_hour": lambda s, d: S.next_hour_outlook(B.conditions(s, d), _hourly_rule).drop("next_confidence"),
    "g17_live_report": _live,
    "g18_alert_block": lambda s, d: K.alert_block(_base(s, d), B.segments(s, d)).select(
        "scenario_id", _joined("segments").alias("segments"), "alert_count", "alert_active"),
    "i1_contributing_factors": lambda s, d: _text_block(_pred(s, d).transform(X.explain)),
    "i2_narrative": lambda s, d: _pred(s, d).transform(X.explain).select("scenario_id", "narrative"),
    "i3_immediate_actions": lambda s, d: _pred(s, d).transform(X.plan_actions).select(
        "scenario_id", _joined("immediate_actions").alias("actions")),
    "i4_context_agent": lambda s, d: _plan(s, d, "agent"),
    "i4_context_tool": lambda s, d: _plan(s, d, "tool"),
    "i4_context_panel": lambda s, d: _plan(s, d, "panel"),
    "i5_urgency": lambda s, d: _levels(s, d).select(
        "obs_id", X.urgency(F.col("level"), "agent").alias("agent"), X.urgency(F.col("level"), "tool").alias("tool")),
    "i6_level_description": lambda s, d: _levels(s, d).transform(X.describe_levels),
    "i7_system_findings": lambda s, d: lean(s, d).transform(X.system_findings),
    "i8_findings_by_priority": lambda s, d: lean(s, d).transform(X.system_findings_by_priority).select(
        "title", "finding", "recommendation", "priority"),
    "i9_congestion_report": lambda s, d: X.congestion_report(B.conditions(s, d), RULE, PLACE).select(
        "scenario_id", "headline", "label", "narrative", "conditions_summary", "urgency",
        _joined("contextual_actions").alias("actions")),
    "i10_predict_explain_plan": lambda s, d: X.predict_explain_plan(B.conditions(s, d), RULE).select(
        "scenario_id", "pred_code", "label", "narrative", F.size("factors").alias("n_factors"),
        _joined("immediate_actions").alias("immediate"), _joined("contextual_actions").alias("contextual"), "urgency"),
    "l1_alert_stream": _stream,
    "l1_alert_batch": lambda s, d: corridor_alerts(B.conditions(s, d), B.segments(s, d), RULE).select(
        "scenario_id", "name", "segment_label", "segment_code"),
}

# --- checking SQL -----------------------------------------------------------------------

_CLOCK = "printf('%02d:00', {h})"
_D = {k: text(v) for k, v in V.FACTOR_DETAIL.items()}
# (condition, factor text, impact, detail) in rule order
_RULES = (
    ("is_rush_hour = 1 AND hour < 12", "'Morning rush hour (' || hour || ':00)'", "high", _D["rush"]),
    ("is_rush_hour = 1 AND hour >= 12", "'Evening rush hour (' || hour || ':00)'", "high", _D["rush"]),
    ("is_weekend = 1", "'Weekend'", "reducing", _D["weekend"]),
    ("is_weekend = 0", f"'Weekday (' || {day_long('day_of_week')} || ')'", "moderate", _D["weekday"]),
    ("is_holiday = 1", "'Public Holiday'", "reducing", _D["holiday"]),
    ("rain_1h > 5", "printf('Heavy rain (%.1f mm/hr)', rain_1h)", "high", _D["heavy_rain"]),
    ("rain_1h > 0.5 AND rain_1h <= 5", "printf('Light rain (%.1f mm/hr)', rain_1h)", "moderate", _D["light_rain"]),
    ("snow_1h > 0", "printf('Snow (%.2f cm)', snow_1h)", "high", _D["snow"]),
    ("weather_code >= 4", "'Poor visibility (fog/thunderstorm)'", "high", _D["visibility"]),
    ("traffic_lag_1h > 4500", "format('Prior hour also heavy ({:,} vehicles)', CAST(traffic_lag_1h AS BIGINT))", "high", _D["prior_heavy"]),
    ("traffic_lag_1h < 1000", "format('Prior hour was light ({:,} vehicles)', CAST(traffic_lag_1h AS BIGINT))", "reducing", _D["prior_light"]),
    ("hour < 5 OR hour >= 23", "'Late night / early morning (' || hour || ':00)'", "reducing", _D["night"]),
)


def _rule_list(impact: str | None, full: bool, sep: str) -> str:
    parts = []
    for cond, factor, kind, detail in _RULES:
        if impact in (None, kind):
            value = f"{factor} || '/{kind}/' || {detail}" if full else factor
            parts.append(f"CASE WHEN {cond} THEN {value} END")
    return f"concat_ws('{sep}', {', '.join(parts)})"


_NARRATIVE = f"""concat_ws(' ', {case('label', V.LEVEL_SUMMARY)},
  CASE WHEN highs <> '' THEN 'Primary drivers: ' || highs || '.' END,
  CASE WHEN reds <> '' THEN 'Mitigating factors: ' || reds || '.' END, {case('label', V.LEVEL_IMPACT)})"""


def _context(variant: str) -> str:
    t = V.CONTEXT_ACTIONS[variant]
    cond = {
        "rush": "is_rush_hour = 1 AND pred_code >= 2", "rain": "rain_1h > 2", "night": "hour < 6",
        "confidence": "FALSE", "police": "is_rush_hour = 1 AND pred_code = 3",
    }
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {cond[k]} THEN {text(v)} END" for k, v in t.items()) + ")"


_IMMEDIATE = case("label", {k: "|".join(v) for k, v in V.IMMEDIATE_ACTIONS.items()})
_URGENCY = case("label", V.URGENCY)
_ROUND_TEMP = "CAST(CAST(round_even(temp_celsius, 0) AS INTEGER) AS VARCHAR)"
_TEXTS = f""",
texts AS (SELECT *, {_rule_list(None, True, '|')} AS factors, {_rule_list('high', False, ', ')} AS highs,
  {_rule_list('reducing', False, ', ')} AS reds FROM pred),
told AS (SELECT *, {_NARRATIVE} AS narrative FROM texts)
"""
_NFACTORS = " + ".join(f"CAST(({c}) AS INTEGER)" for c, *_ in _RULES)


def _told(query: str) -> str:
    return sql("SELECT 1").removesuffix("SELECT 1").rstrip() + _TEXTS + query


def _plan_sql(variant: str) -> str:
    return sql(f"SELECT scenario_id, {_context(variant)} AS actions, {_URGENCY} AS urgency FROM pred")


_ASK = f""",
ask AS (SELECT *, CASE scenario_id % 3 WHEN 0 THEN 'SUPPLIER#' || printf('%09d', corridor_id * 16 + scenario_id % 8)
  WHEN 1 THEN substr(printf('%09d', corridor_id * 16 + scenario_id % 8), 8, 2) ELSE 'no such place' END AS segment_query FROM pred),
matched AS (SELECT a.*, s.name AS segment_name, s.factor AS segment_factor FROM ask a LEFT JOIN segs s
  ON s.corridor_id = a.corridor_id AND s.ordinal = (SELECT x.ordinal FROM segs x WHERE x.corridor_id = a.corridor_id
    AND contains(lower(x.name), lower(a.segment_query))
    ORDER BY lower(x.name) <> lower(a.segment_query), x.ordinal LIMIT 1)),
walk AS (SELECT scenario_id, segment_name, segment_factor, h.hour,
  CAST({segment('pred_code', 'segment_factor')} AS INTEGER) AS code
  FROM matched CROSS JOIN hours24 h WHERE segment_name IS NOT NULL)
"""


def _asked(query: str) -> str:
    return sql("SELECT 1").removesuffix("SELECT 1").rstrip() + _ASK + query


def _finding_sql() -> str:
    pct = lambda a, b: f"round(({a}) / greatest({b}, 1) * 100, 1)"
    whole = lambda x: f"format('{{:,}}', CAST(trunc({x}) AS BIGINT))"
    fields = {
        "rush_pct": pct("rush_avg - weekday_avg", "weekday_avg"), "peak_hour": "peak_hour", "trough_hour": "trough_hour",
        "weekday_avg": whole("weekday_avg"), "weekend_avg": whole("weekend_avg"),
        "diff_pct": pct("weekday_avg - weekend_avg", "weekday_avg"), "peak_day": "peak_day",
        "holiday_avg": whole("holiday_avg"), "hol_pct": pct("weekday_avg - holiday_avg", "weekday_avg"),
        "top_weather": "top_weather", "top_volume": whole("top_weather_avg"), "low_weather": "low_weather",
        "low_volume": whole("low_weather_avg"), "month_name": month_short("worst_month"),
    }

    def fill(t: str) -> str:
        e = text(t)
        for k, v in fields.items():
            e = f"replace({e}, '{{{k}}}', CAST({v} AS VARCHAR))" if "{" + k + "}" in t else e
        return e

    rows = [
        f"SELECT {i} AS ordinal, {fill(t)} AS title, {fill(f)} AS finding, {fill(r)} AS recommendation, {text(p)} AS priority FROM peak"
        for i, (t, f, r, p) in enumerate(V.FINDINGS.values())
    ]
    return " UNION ALL ".join(rows)


_ALERTS = "SELECT scenario_id, name, segment_label, segment_code FROM seg_state WHERE segment_code >= 2"
_SHORT = "scenario_id, name, exit, factor, segment_label, color_hex, lat_center, lon_center, is_bottleneck"
_HOURS = "coalesce(string_agg(CASE WHEN code = {c} THEN " + _CLOCK.format(h="hour") + " END, '|' ORDER BY hour), '')"
_SCORE = "round(code / 3.0e0 * 100, 1)"

ORACLE = {
    "j3_scenario_hours": sql("""SELECT scenario_id, h.hour, CAST(CASE WHEN h.hour BETWEEN 7 AND 9 THEN 1
        WHEN h.hour BETWEEN 16 AND 18 THEN 2 ELSE 0 END AS INTEGER) AS rush_type FROM cond CROSS JOIN hours24 h"""),
    "j4_scenario_segments": sql("SELECT scenario_id, ordinal, factor FROM cond JOIN segs USING (corridor_id)"),
    "g1_risk_by_hour": sql(f"SELECT scenario_id, hour, {label('code')} AS label, code, {_SCORE} AS risk_score FROM risk"),
    "g2_risk_summary": sql(f"""SELECT scenario_id,
        (max(struct_pack(c := code, h := -hour, t := {_CLOCK.format(h='hour')}))).t AS peak_hour,
        round(avg({_SCORE}), 1) AS avg_risk, {_HOURS.format(c=3)} AS severe_hours, {_HOURS.format(c=2)} AS high_hours
        FROM risk GROUP BY scenario_id"""),
    "g3_score_conditions": _told("""SELECT scenario_id, label, pred_code, CAST(NULL AS DOUBLE) AS confidence, narrative,
        is_rush_hour, is_weekend, factors FROM told"""),
    "g4_score_hours": sql("""SELECT scenario_id, CAST(position AS INTEGER) AS position, CAST(CASE position WHEN 0 THEN 17
        WHEN 1 THEN 8 ELSE (hour + 5) % 24 END AS INTEGER) AS hour, label, pred_code AS code
        FROM pred CROSS JOIN (SELECT range AS position FROM range(3))"""),
    "g5_feature_vector": sql("SELECT scenario_id, " + ", ".join(
        f"round(CAST({f} AS DOUBLE), 6) AS {f}" for f in V.FEATURES) + " FROM cfeat"),
    "g6_score_now": sql("""SELECT scenario_id, hour, label, strftime(date_time, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
        strftime(date_time, '%H:%M') AS local_time, strftime(date_time, '%A') AS day_name,
        strftime(date_time, '%Y-%m-%d') AS date FROM pred"""),
    "g7_segment_code": sql("SELECT scenario_id, " + ", ".join(
        f"CAST({segment('pred_code', f'{f}e0')} AS INTEGER) AS at_{int(f * 100)}" for f in (0.7, 1.0, 1.5)) + " FROM pred"),
    "g8_corridor_state": sql(f"SELECT {', '.join(STATE_COLUMNS)} FROM seg_state"),
    "g9_corridor_summary": sql("""SELECT scenario_id, count(*) FILTER (WHERE segment_code = 3) AS severe_count,
        count(*) FILTER (WHERE segment_code = 2) AS high_count, count(*) AS total_segments,
        first(name ORDER BY segment_code DESC, factor DESC, ordinal) AS worst_segment,
        first(name ORDER BY segment_code, factor DESC, ordinal) AS safest_segment FROM state GROUP BY 1"""),
    "g10_bottlenecks": sql("SELECT scenario_id, name, segment_code FROM state WHERE segment_code >= 2"),
    "g10_bottlenecks_short": sql(f"SELECT {_SHORT} FROM seg_state WHERE segment_code >= 3"),
    "g10_unknown_level": sql(f"SELECT {_SHORT} FROM seg_state WHERE segment_code >= 2"),
    "g11_find_segments": _asked("""SELECT scenario_id, segment_query, segment_name, segment_factor,
        CASE WHEN segment_name IS NULL THEN 'Segment ''' || segment_query || ''' not found.' END AS error FROM matched"""),
    "g12_segment_history": _asked(f"""SELECT scenario_id, segment_name, segment_factor, hour, {_CLOCK.format(h='hour')} AS hour_str,
        {label('code')} AS label, code, {_SCORE} AS risk_score FROM walk"""),
    "g12_history_summary": _asked(f"""SELECT scenario_id, segment_name, segment_factor,
        first({_CLOCK.format(h='hour')} ORDER BY code DESC, hour) AS peak_hour, {label('max(code)')} AS peak_label,
        {_HOURS.format(c=0)} AS safe_hours, segment_factor > 1 AS is_bottleneck FROM walk GROUP BY 1, 2, 3"""),
    "g13_segment_metadata": sql("""SELECT corridor_id, ordinal, name, exit, factor, lat_center, lon_center,
        factor > 1 AS is_bottleneck FROM segs"""),
    "g14_segment_list": sql("SELECT corridor_id, ordinal, name, exit, factor, factor > 1 AS is_bottleneck FROM segs"),
    "g15_segments_by_factor": sql("""SELECT corridor_id, ordinal, name, exit, factor, factor > 1 AS is_bottleneck FROM segs
        ORDER BY factor DESC, corridor_id, ordinal"""),
    "g16_next_hour": sql(f"""SELECT scenario_id, code, {label('code')} AS label, next_hour, next_code, {label('next_code')} AS next_label,
        CASE WHEN next_code > code THEN 'up' WHEN next_code < code THEN 'down' ELSE 'steady' END AS trend FROM (
        SELECT scenario_id, CAST((pred_code + hour // 2 % 3) % 4 AS INTEGER) AS code, CAST((hour + 1) % 24 AS INTEGER) AS next_hour,
        CAST((pred_code + (hour + 1) % 24 // 2 % 3) % 4 AS INTEGER) AS next_code FROM pred)"""),
    "g17_live_report": sql("""SELECT p.scenario_id, strftime(date_time, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
        strftime(date_time, '%H:%M') AS local_time, strftime(date_time, '%Y-%m-%d') AS date,
        strftime(date_time, '%A') AS day_name, label, pred_code AS code, CAST((hour + 1) % 24 AS INTEGER) AS next_hour,
        label AS next_label, 'steady' AS trend, r.codes AS risk_codes, c.codes AS corridor_codes,
        CAST(c.alerts AS INTEGER) AS alert_count, c.alerts > 0 AS alert_active, c.alerts - c.severe AS high_count,
        c.severe AS severe_count, c.total AS total_segments, c.worst AS worst_segment, c.safest AS safest_segment FROM pred p
        JOIN (SELECT scenario_id, string_agg(CAST(code AS VARCHAR), '' ORDER BY hour) AS codes FROM risk GROUP BY 1) r
          ON p.scenario_id = r.scenario_id
        JOIN (SELECT scenario_id, string_agg(CAST(segment_code AS VARCHAR), '' ORDER BY ordinal) AS codes,
          count(*) FILTER (WHERE segment_code >= 2) AS alerts, count(*) FILTER (WHERE segment_code = 3) AS severe, count(*) AS total,
          first(name ORDER BY segment_code DESC, factor DESC, ordinal) AS worst,
          first(name ORDER BY segment_code, factor DESC, ordinal) AS safest FROM state GROUP BY 1) c ON p.scenario_id = c.scenario_id"""),
    "g18_alert_block": sql("""SELECT scenario_id,
        coalesce(string_agg(CASE WHEN segment_code >= 2 THEN name END, '|' ORDER BY ordinal), '') AS segments,
        CAST(count(*) FILTER (WHERE segment_code >= 2) AS INTEGER) AS alert_count,
        count(*) FILTER (WHERE segment_code >= 2) > 0 AS alert_active FROM state GROUP BY 1"""),
    "i1_contributing_factors": _told("SELECT scenario_id, label, factors FROM told"),
    "i2_narrative": _told("SELECT scenario_id, narrative FROM told"),
    "i3_immediate_actions": sql(f"SELECT scenario_id, {_IMMEDIATE} AS actions FROM pred"),
    "i4_context_agent": _plan_sql("agent"),
    "i4_context_tool": _plan_sql("tool"),
    "i4_context_panel": _plan_sql("panel"),
    "i5_urgency": sql(f"""SELECT obs_id, {case('level', V.URGENCY, "'LOW'")} AS agent, {case('level', V.URGENCY, "'NORMAL'")} AS tool
        FROM (SELECT obs_id, CASE WHEN obs_id % 5 = 0 THEN 'Extreme' ELSE congestion_label END AS level FROM lab)"""),
    "i6_level_description": sql(f"""SELECT obs_id, level, {case('level', V.LEVEL_EMOJI)} AS emoji, {case('level', V.LEVEL_SUMMARY)} AS summary,
        {case('level', V.LEVEL_IMPACT)} AS impact,
        CASE WHEN level = 'Extreme' THEN 'Unknown level ''Extreme''. Use: Low, Medium, High, Severe.' END AS error
        FROM (SELECT obs_id, CASE WHEN obs_id % 5 = 0 THEN 'Extreme' ELSE congestion_label END AS level FROM lab)"""),
    "i7_system_findings": sql(_finding_sql()),
    "i8_findings_by_priority": sql(f"SELECT title, finding, recommendation, priority FROM ({_finding_sql()})"),
    "i9_congestion_report": _told(f"""SELECT scenario_id, {case('label', V.LEVEL_EMOJI)} || ' {PLACE} Traffic Alert — ' || label
        || ' congestion predicted at ' || {_CLOCK.format(h='hour')} || ' on ' || {day_long('day_of_week')} || ', '
        || {month_short('month')} AS headline, label, narrative, concat_ws(' · ', {_CLOCK.format(h='hour')},
        CASE WHEN rain_1h > 0 THEN printf('Rain %.1fmm/hr', rain_1h) END, CASE WHEN is_holiday = 1 THEN 'Holiday' END,
        CASE WHEN is_rush_hour = 1 THEN 'Rush hour' END, {_ROUND_TEMP} || '°C') AS conditions_summary,
        {_URGENCY} AS urgency, {_context('report')} AS actions FROM told"""),
    "i10_predict_explain_plan": _told(f"""SELECT scenario_id, pred_code, label, narrative, CAST({_NFACTORS} AS INTEGER) AS n_factors,
        {_IMMEDIATE} AS immediate, {_context('agent')} AS contextual, {_URGENCY} AS urgency FROM told"""),
    "l1_alert_stream": sql(_ALERTS),
    "l1_alert_batch": sql(_ALERTS),
}
