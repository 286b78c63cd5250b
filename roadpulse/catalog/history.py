"""Queries over sources, cleaning, features, windows and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.catalog.base_sql import WEATHER, label, sql
from roadpulse.functions import columns as C
from roadpulse.operators import cleaning, features, quantiles, ranking, series
from roadpulse.operators.aggregates import peak_position, weather_ranking
from roadpulse.operators.explain import system_findings_by_priority
from roadpulse.plans.batch import labelled_calendar, labelled_rows, prepared_history
from roadpulse.session import scratch_path
from roadpulse.sources import bindings as B
from roadpulse.sources import observations as O
from roadpulse.sources.artifacts import as_json_records
from roadpulse.streaming.lag_stream import read_observation_stream, run_lag_stream

OBS = "obs_id, sensor_id, date_time, traffic_volume, temp, rain_1h, snow_1h, clouds_all, weather_main, weather_description, holiday"


def raw(spark: SparkSession, d: str) -> DataFrame:
    return B.observations(spark, d)


def uniq(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).transform(cleaning.drop_exact_duplicates)


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).transform(cleaning.clean)


def calendar(spark: SparkSession, d: str) -> DataFrame:
    return uniq(spark, d).transform(features.calendar_features)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).transform(labelled_rows)


def lean(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).transform(labelled_calendar)


def history(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).transform(prepared_history)


def rounded(df: DataFrame, digits: int = 9, columns=("hour_sin", "hour_cos", "month_sin", "month_cos")) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns if c in df.columns})


MEANS = ("traffic_rolling_3h", "traffic_rolling_6h")


def _csv_round_trip(spark, d):
    path = scratch_path(spark, "observations")
    O.write_observations_csv(raw(spark, d).select("obs_id", *O.OBSERVATION.names), path)
    return O.read_observations(spark, path, extra="obs_id long")


def _quarantine(spark, d):
    """A file in which some lines are broken: rows that are read, and rejected lines from the table they are kept in."""
    n = F.col("obs_id")
    when = F.when(n % 31 == 0, F.lit("2023-13-45 99:00:00")).otherwise(F.col("date_time").cast("string"))
    volume = F.when((n % 37 == 0) & F.col("traffic_volume").isNotNull(), F.lit("many")).otherwise(F.col("traffic_volume").cast("string"))
    fields = [F.coalesce(c.cast("string"), F.lit("")) for c in (
        n, F.col("holiday"), F.col("temp"), F.col("rain_1h"), F.col("snow_1h"), F.col("clouds_all"), F.col("weather_main"),
        F.col("weather_description"), when, volume)]
    line = F.concat_ws(",", *fields)
    line = F.when(n % 41 == 0, F.concat(line, F.lit(",more"))).when(n % 43 == 0, F.concat_ws(",", *fields[:5])).otherwise(line)
    header = ",".join(["obs_id", *O.OBSERVATION.names])
    path, kept = scratch_path(spark, "observations"), scratch_path(spark, "quarantine")
    raw(spark, d).select(line.alias(header)).write.option("header", True).option("quote", "").option("escape", "").option("sep", "\u0001").csv(path)
    rows, rejected = O.split_observations(spark, path, extra="obs_id long")
    O.quarantine(rejected, kept)
    reason = F.lit(None).cast("string").alias("reason")
    gone = spark.read.schema("text string, reason string").parquet(kept)
    return rows.select("obs_id", "date_time", "traffic_volume", reason).unionByName(gone.select(
        F.split_part("text", F.lit(","), F.lit(1)).cast("long").alias("obs_id"), F.lit(None).cast("timestamp_ntz").alias("date_time"),
        F.lit(None).cast("int").alias("traffic_volume"), "reason"))


def _reference_csv(spark, d):
    """The nine columns of an observation file, without any key, from CSV to feature rows."""
    path = scratch_path(spark, "observations")
    O.write_observations_csv(raw(spark, d).select(*O.OBSERVATION.names), path)
    return prepared_history(O.read_observations(spark, path)).select(
        "date_time", "traffic_volume", "congestion_code", F.round("temp_celsius", 6).alias("temp_celsius"), "traffic_lag_1h", "traffic_lag_24h"
    )


def _table_round_trip(spark, d):
    path = scratch_path(spark, "observation-table")
    O.write_observation_table(cleaned(spark, d), path)
    return O.read_observation_table(spark, path).groupBy("obs_year").agg(
        F.count(F.lit(1)).alias("n")
    )


def _by_sensor(spark, d):
    df = uniq(spark, d).transform(series.lag_features, keys=("sensor_id",), bounds_from=raw(spark, d))
    return rounded(df.select("obs_id", "sensor_id", *[c for c in df.columns if c.startswith("traffic_") and c != "traffic_volume"]), 6, MEANS)


def _lag_stream(spark, d):
    """The observations in four arrivals by time, each met by a new start of the stream; gaps have the median of all."""
    df = uniq(spark, d).select("obs_id", "sensor_id", "date_time", "traffic_volume")
    micros = F.unix_micros(F.col("date_time").cast("timestamp"))
    cuts = df.agg(F.percentile_approx(micros, [0.25, 0.5, 0.75])).first()[0] or []
    number = sum((F.when(micros > c, 1).otherwise(0) for c in cuts), F.lit(0))
    fill = df.transform(series.median_value, "traffic_volume").first()["median"]
    source, out, state = (scratch_path(spark, n) for n in ("readings", "lags", "lag-state"))
    for k in range(len(cuts) + 1):
        df.where(number == k).write.mode("append").parquet(source)
        run_lag_stream(read_observation_stream(spark, source, df.schema), out, state, fill=fill).awaitTermination()
    told = spark.read.parquet(out)
    return rounded(told.select("obs_id", "sensor_id", *[c for c in told.columns if c.startswith("traffic_") and c != "traffic_volume"]), 6, MEANS)


def _conditions_features(spark, d):
    f = B.conditions(spark, d).transform(features.condition_features)
    return rounded(rounded(features.feature_matrix(f, "scenario_id")), 6, V.FEATURES[-3:])


def _history_row(df):
    return rounded(rounded(df), 6, (*MEANS, "temp", "temp_celsius"))


def _series(spark, d):
    return uniq(spark, d).transform(series.lag_features, bounds_from=raw(spark, d))


def _value_quartiles(spark, d):
    """Exact quartiles of a continuous measure per kind of event, selected by bits."""
    events = spark.read.parquet(f"{d}/events.parquet").select("event_type", "value")
    found = quantiles.exact_quantiles(events, "value", [0.25, 0.5, 0.75], ["event_type"], "q")
    return found.select("event_type", *[F.round(F.col("q")[i], 9).alias(c) for i, c in enumerate(("q1", "median", "q3"))])


def _continuous_repair(spark, d):
    """Zero temperatures repaired with medians selected by bits."""
    return uniq(spark, d).transform(cleaning.repair_zero_temperature, continuous=True).select("obs_id", F.round("temp", 6).alias("temp"))


QUERIES = {
    "c2_continuous_repair": _continuous_repair,
    "w4_value_quartiles": _value_quartiles,
    # sources
    "s1_observation_csv": _csv_round_trip,
    "s1_observation_table": _table_round_trip,
    "s1_reference_csv": _reference_csv,
    "s1_quarantine": _quarantine,
    "s7_json_records": lambda s, d: lean(s, d).transform(
        lambda x: as_json_records(x.groupBy("hour").agg(F.round(F.avg("traffic_volume"), 1).alias("avg_volume")))
    ),
    "s8_preview": lambda s, d: rounded(labelled(s, d).transform(ranking.preview), 6, ("temp_celsius",)),
    # cleaning
    "c1_exact_duplicates": uniq,
    "c2_zero_temperature": lambda s, d: uniq(s, d).transform(cleaning.repair_zero_temperature).select("obs_id", "temp"),
    "c3_rain_cap": lambda s, d: uniq(s, d).transform(cleaning.cap).select("obs_id", "rain_1h"),
    "c4_holiday_fill": lambda s, d: uniq(s, d).transform(cleaning.fill_holiday).select("obs_id", "holiday"),
    "c5_drop_unlabelled": lambda s, d: uniq(s, d).transform(features.label_congestion)
    .transform(cleaning.drop_unlabelled).select("obs_id", "congestion_label"),
    "c6_zero_readings": lambda s, d: uniq(s, d).transform(cleaning.zero_volume_count),
    "c7_severe_in_rush": lambda s, d: lean(s, d).transform(cleaning.severe_in_rush).select("obs_id", "hour", "traffic_volume"),
    "c7_in_period": lambda s, d: calendar(s, d).transform(cleaning.in_period, "hour", 7, 9)
    .where((F.col("rain_1h") > 0) & (F.col("weather_main") != "Snow")).select("obs_id", "hour", "rain_1h"),
    # features
    "p1_calendar": lambda s, d: calendar(s, d).select("obs_id", "hour", "day_of_week", "month", "year", "day_of_year"),
    "p2_weekend": lambda s, d: calendar(s, d).select("obs_id", "is_weekend"),
    "p3_rush": lambda s, d: calendar(s, d).transform(features.rush_features).select(
        "obs_id", "is_morning_rush", "is_evening_rush", "is_rush_hour", "rush_type"),
    "p4_cyclic": lambda s, d: rounded(calendar(s, d).transform(features.cyclic_features).select(
        "obs_id", "hour_sin", "hour_cos", "month_sin", "month_cos")),
    "p5_holiday": lambda s, d: cleaned(s, d).transform(features.holiday_feature).select("obs_id", "is_holiday"),
    "p6_celsius": lambda s, d: cleaned(s, d).transform(features.weather_features).select(
        "obs_id", F.round("temp_celsius", 6).alias("temp_celsius")),
    "p7_wet_flags": lambda s, d: cleaned(s, d).transform(features.weather_features).select(
        "obs_id", "is_raining", "is_snowing"),
    "p8_severity": lambda s, d: cleaned(s, d).transform(features.weather_features).select(
        "obs_id", "weather_severity", C.weather_severity(F.col("rain_1h"), F.col("snow_1h"), "serve").alias("severity_serving")),
    "p9_weather_code": lambda s, d: uniq(s, d).select("obs_id", C.weather_code(F.col("weather_main")).alias("weather_code")),
    "p10_congestion": lambda s, d: uniq(s, d).transform(features.label_congestion).select(
        "obs_id", "congestion_code", "congestion_label"),
    "p11_feature_matrix": lambda s, d: rounded(rounded(features.feature_matrix(history(s, d), "obs_id")), 6, (*MEANS, "temp_celsius")),
    "p12_condition_features": _conditions_features,
    "p13_default_lags": lambda s, d: rounded(B.conditions(s, d).transform(features.default_lags).select(
        "scenario_id", *V.FEATURES[-4:]), 6, V.FEATURES[-3:]),
    "p14_prepared_history": lambda s, d: _history_row(history(s, d)),
    # windows and sorts
    "w1_by_time": lambda s, d: uniq(s, d).transform(ranking.by_time).select("obs_id", "date_time", "traffic_volume"),
    "w2_lags": lambda s, d: _series(s, d).select("obs_id", "traffic_lag_1h", "traffic_lag_24h"),
    "w3_trailing_means": lambda s, d: rounded(_series(s, d).select("obs_id", *MEANS), 6, MEANS),
    "w2_w3_by_sensor": _by_sensor,
    "l1_lag_stream": _lag_stream,
    "w4_median": lambda s, d: uniq(s, d).transform(series.median_value, "traffic_volume"),
    "w5_peak_hour": lambda s, d: lean(s, d).transform(peak_position, "hour"),
    "w5_peak_month": lambda s, d: lean(s, d).transform(peak_position, "month"),
    "w7_weather_ranking": lambda s, d: lean(s, d).transform(weather_ranking),
    "w8_priority_order": lambda s, d: lean(s, d).transform(system_findings_by_priority).select("ordinal", "priority"),
    "w9_busiest_rows": lambda s, d: lean(s, d).transform(ranking.top_k, 15, "traffic_volume", "obs_id").select(
        "obs_id", "traffic_volume"),
    # joins
    "j1_hour_medians": lambda s, d: uniq(s, d).transform(cleaning.hourly_medians, "temp").select(
        F.col("_hour").alias("hour"), F.col("_median").alias("median_temp")),
    "j2_lookups": lambda s, d: calendar(s, d).select(
        "obs_id", C.weather_code(F.col("weather_main")).alias("weather_code"),
        C.day_short(F.col("day_of_week")).alias("day_name"), C.month_short(F.col("month")).alias("month_name")),
}

_SERIES = "traffic_lag_1h, traffic_lag_24h, round(traffic_rolling_3h, 6) AS traffic_rolling_3h, round(traffic_rolling_6h, 6) AS traffic_rolling_6h"
_MATRIX = ", ".join(
    f"round({c}, 6) AS {c}" if c in (*MEANS, "temp_celsius") else c for c in V.FEATURES
)

ORACLE = {
    "s1_observation_csv": sql(f"SELECT {OBS.replace('sensor_id, ', '')} FROM raw"),
    "s1_reference_csv": sql("""SELECT date_time, traffic_volume, congestion_code, round(temp_celsius, 6) AS temp_celsius,
        traffic_lag_1h, traffic_lag_24h FROM hist"""),
    "s1_quarantine": sql("""SELECT obs_id, CASE WHEN reason IS NULL THEN date_time END AS date_time,
        CASE WHEN reason IS NULL THEN traffic_volume END AS traffic_volume, reason FROM (
        SELECT obs_id, date_time, traffic_volume, CASE WHEN obs_id % 41 = 0 OR obs_id % 43 = 0 THEN 'fields'
        WHEN obs_id % 31 = 0 THEN 'date_time' WHEN obs_id % 37 = 0 AND traffic_volume IS NOT NULL THEN 'traffic_volume' END AS reason FROM raw)"""),
    "s1_observation_table": sql("SELECT CAST(year(date_time) AS INTEGER) AS obs_year, count(*) AS n FROM cleaned GROUP BY 1"),
    "s7_json_records": sql("""SELECT '{"hour":' || hour || ',"avg_volume":' || a || '}' AS record FROM by_hour"""),
    "s8_preview": sql("""SELECT date_time, traffic_volume, congestion_label, hour, is_rush_hour, is_weekend, weather_main,
        round(temp_celsius, 6) AS temp_celsius, rain_1h FROM lab ORDER BY date_time, obs_id LIMIT 200"""),
    "c1_exact_duplicates": sql(f"SELECT {OBS} FROM uniq"),
    "c2_zero_temperature": sql("SELECT obs_id, temp FROM cleaned"),
    "c2_continuous_repair": sql("SELECT obs_id, round(temp, 6) AS temp FROM cleaned"),
    "w4_value_quartiles": """SELECT event_type, round(quantile_cont(value, 0.25), 9) AS q1, round(quantile_cont(value, 0.5), 9) AS median,
        round(quantile_cont(value, 0.75), 9) AS q3 FROM events GROUP BY 1""",
    "c3_rain_cap": sql("SELECT obs_id, rain_1h FROM cleaned"),
    "c4_holiday_fill": sql("SELECT obs_id, holiday FROM cleaned"),
    "c5_drop_unlabelled": sql("SELECT obs_id, congestion_label FROM lab"),
    "c6_zero_readings": sql("SELECT count(*) FILTER (WHERE traffic_volume = 0) AS zero_readings FROM uniq"),
    "c7_severe_in_rush": sql("SELECT obs_id, hour, traffic_volume FROM lab WHERE congestion_code = 3 AND is_rush_hour = 1"),
    "c7_in_period": sql("""SELECT obs_id, CAST(hour(date_time) AS INTEGER) AS hour, rain_1h FROM uniq
        WHERE hour(date_time) >= 7 AND hour(date_time) <= 9 AND rain_1h > 0 AND weather_main <> 'Snow'"""),
    "p1_calendar": sql("SELECT obs_id, hour, day_of_week, month, year, day_of_year FROM timed"),
    "p2_weekend": sql("SELECT obs_id, is_weekend FROM feat"),
    "p3_rush": sql("SELECT obs_id, is_morning_rush, is_evening_rush, is_rush_hour, rush_type FROM feat"),
    "p4_cyclic": sql("SELECT obs_id, hour_sin, hour_cos, month_sin, month_cos FROM feat"),
    "p5_holiday": sql("SELECT obs_id, is_holiday FROM feat"),
    "p6_celsius": sql("SELECT obs_id, round(temp_celsius, 6) AS temp_celsius FROM feat"),
    "p7_wet_flags": sql("SELECT obs_id, is_raining, is_snowing FROM feat"),
    "p8_severity": sql("""SELECT obs_id, weather_severity, CAST(CASE WHEN rain_1h = 0 THEN 0 WHEN rain_1h < 2.5e0 THEN 1
        WHEN rain_1h < 7.6e0 THEN 2 ELSE 3 END + is_snowing AS DOUBLE) AS severity_serving FROM feat"""),
    "p9_weather_code": sql(f"SELECT obs_id, CAST({WEATHER} AS DOUBLE) AS weather_code FROM uniq"),
    "p10_congestion": sql(f"SELECT obs_id, congestion_code, {label('congestion_code')} AS congestion_label FROM feat"),
    "p11_feature_matrix": sql(f"SELECT obs_id, {_MATRIX} FROM hist"),
    "p12_condition_features": sql("SELECT scenario_id, " + ", ".join(
        f"round({c}, 6) AS {c}" if c in V.FEATURES[-3:] else c for c in V.FEATURES) + " FROM cfeat"),
    "p13_default_lags": sql("""SELECT scenario_id, traffic_lag_1h, round(traffic_lag_24h, 6) AS traffic_lag_24h,
        round(traffic_rolling_3h, 6) AS traffic_rolling_3h, round(traffic_rolling_6h, 6) AS traffic_rolling_6h FROM cfeat"""),
    "p14_prepared_history": sql(f"""SELECT obs_id, sensor_id, date_time, traffic_volume, round(temp, 6) AS temp, weather_main,
        weather_description, holiday, congestion_code, congestion_label, {_MATRIX} FROM hist"""),
    "w1_by_time": sql("SELECT obs_id, date_time, traffic_volume FROM uniq ORDER BY date_time, obs_id"),
    "w2_lags": sql("SELECT obs_id, traffic_lag_1h, traffic_lag_24h FROM lagged"),
    "w3_trailing_means": sql("""SELECT obs_id, round(traffic_rolling_3h, 6) AS traffic_rolling_3h,
        round(traffic_rolling_6h, 6) AS traffic_rolling_6h FROM lagged"""),
    "w2_w3_by_sensor": sql(f"SELECT obs_id, sensor_id, {_SERIES} FROM lagged_sensor"),
    "l1_lag_stream": sql(f"SELECT obs_id, sensor_id, {_SERIES} FROM lagged_sensor"),
    "w4_median": sql("SELECT med AS median FROM med"),
    "w5_peak_hour": sql("SELECT peak_hour, trough_hour FROM peak"),
    "w5_peak_month": sql("""SELECT worst_month AS peak_month,
        (SELECT month FROM by_month ORDER BY a, month LIMIT 1) AS trough_month FROM peak"""),
    "w7_weather_ranking": sql("SELECT weather_main, a AS avg_volume FROM by_weather ORDER BY a DESC, weather_main"),
    "w8_priority_order": "SELECT * FROM (VALUES (0, 'HIGH'), (5, 'HIGH'), (1, 'MEDIUM'), (3, 'MEDIUM'), (4, 'MEDIUM'), (2, 'LOW')) t(ordinal, priority)",
    "w9_busiest_rows": sql("SELECT obs_id, traffic_volume FROM lab ORDER BY traffic_volume DESC, obs_id LIMIT 15"),
    "j1_hour_medians": sql("SELECT CAST(h AS INTEGER) AS hour, m AS median_temp FROM hour_median"),
    "j2_lookups": sql(f"""SELECT obs_id, CAST({WEATHER} AS DOUBLE) AS weather_code, strftime(date_time, '%a') AS day_name,
        strftime(date_time, '%b') AS month_name FROM uniq"""),
}
