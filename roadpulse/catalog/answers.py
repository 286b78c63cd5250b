"""Queries over the aggregate questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.catalog.base_sql import case, day_short, label, month_short, sql
from roadpulse.catalog.history import history, labelled, lean
from roadpulse.operators import aggregates as A


def _r(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


QUERIES = {
    "a1_mean_by_hour": lambda s, d: lean(s, d).transform(A.mean_by, "hour"),
    "a2_mean_by_day": lambda s, d: lean(s, d).transform(A.mean_by_day),
    "a3_mean_by_month": lambda s, d: lean(s, d).transform(A.mean_by, "month"),
    "a4_mean_by_weather": lambda s, d: lean(s, d).transform(A.weather_ranking),
    "a5_conditional_means": lambda s, d: lean(s, d).transform(A.conditional_means),
    "a6_peak_profile": lambda s, d: lean(s, d).transform(A.peak_profile),
    "a6_peak_summary": lambda s, d: lean(s, d).transform(A.peak_summary),
    "a7_dataset_statistics": lambda s, d: lean(s, d).transform(A.dataset_statistics),
    "a8_class_distribution": lambda s, d: lean(s, d).transform(A.class_distribution),
    "a9_rush_statistics": lambda s, d: lean(s, d).transform(A.rush_statistics),
    "a10_weekday_weekend": lambda s, d: lean(s, d).transform(A.weekday_weekend),
    "a11_data_profile": lambda s, d: lean(s, d).transform(A.data_profile),
    "a12_volume_heatmap": lambda s, d: lean(s, d).transform(A.volume_heatmap),
    "a13_congestion_heatmap": lambda s, d: lean(s, d).transform(A.congestion_heatmap),
    "a14_daily_calendar": lambda s, d: lean(s, d).transform(A.daily_calendar),
    "a14_calendar_of_year": lambda s, d: lean(s, d).transform(A.daily_calendar, year=2024),
    "a15_years": lambda s, d: lean(s, d).transform(A.years_available),
    "a16_weather_box": lambda s, d: lean(s, d).transform(A.weather_box),
    "a17_rain_sample": lambda s, d: labelled(s, d).transform(A.rain_sample),
    "a18_temperature_profile": lambda s, d: _r(labelled(s, d).transform(A.temperature_profile), 6, "avg_volume"),
    "a19_severity_profile": lambda s, d: _r(labelled(s, d).transform(A.severity_profile), 6, "avg_volume"),
    "a20_weekday_weekend_by_hour": lambda s, d: _r(
        lean(s, d).transform(A.weekday_weekend_by_hour), 6, "weekday_avg", "weekend_avg"),
    "a21_weekday_weekend_by_month": lambda s, d: lean(s, d).transform(A.weekday_weekend_by_month),
    "a22_peak_months": lambda s, d: lean(s, d).transform(A.peak_months),
    "a23_class_share_by_hour": lambda s, d: lean(s, d).transform(A.class_share_by_hour),
    "a24_weather_extremes": lambda s, d: lean(s, d).transform(A.weather_extremes),
    "a25_wet_dry": lambda s, d: labelled(s, d).transform(A.wet_dry),
    "a26_median_lags_by_hour": lambda s, d: _r(history(s, d).transform(A.median_lags_by_hour), 6, *A.LAGS),
    "a27_rush_schedule": lambda s, d: lean(s, d).transform(A.rush_schedule),
    "j5_complete_hours": lambda s, d: _r(
        history(s, d).transform(A.median_lags_by_hour).transform(A.complete_hours), 6, *A.LAGS),
    "j6_severity_dimension": lambda s, d: labelled(s, d).transform(A.severity_profile)
    .select("severity", "severity_label", F.col("avg_volume").isNull().cast("int").alias("is_empty")),
}


def _pivot(value: str, digits: int) -> str:
    days = ", ".join(
        f"round(avg({value}) FILTER (WHERE day_of_week = {i}), {digits}) AS {n}" for i, n in enumerate(V.DAYS_SHORT)
    )
    return sql(f"SELECT lpad(CAST(hour AS VARCHAR), 2, '0') || ':00' AS hour, {days} FROM lab GROUP BY lab.hour")


def _month_side(side: int) -> str:
    return (
        f"(SELECT month FROM (SELECT month, avg(traffic_volume) AS a FROM lab WHERE is_weekend = {side} GROUP BY 1) "
        "ORDER BY a DESC, month LIMIT 1)"
    )


def _hour_side(side: int) -> str:
    return _month_side(side).replace("month", "hour")


_CALENDAR = """, daily AS (SELECT CAST(date_time AS DATE) AS date, avg(traffic_volume) AS a FROM lab GROUP BY 1),
usual AS (SELECT year(date) AS y FROM daily GROUP BY 1 ORDER BY count(*) DESC, y LIMIT 1)
SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  CAST(weekofyear(date) AS INTEGER) AS week_of_year, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
  strftime(date, '%b %d') AS day_text, round(a, 0) AS avg_volume FROM daily WHERE year(date) = """
_LAG_COLS = "round({a}, 6) AS {b}"
_SEVERITY = case("s.severity", dict(enumerate(V.SEVERITY_LABELS)))
_SCHEDULE = f"""SELECT '7:00 – 9:00 AM' AS morning_rush, '4:00 – 6:00 PM' AS evening_rush, peak_day, worst_month,
  {month_short('worst_month')} AS worst_month_name, rush_avg AS rush_avg_volume, weekday_avg AS weekday_avg_volume FROM peak"""

ORACLE = {
    "a1_mean_by_hour": sql("SELECT hour, a AS avg_volume FROM by_hour"),
    "a2_mean_by_day": sql(f"SELECT day_of_week, {day_short('day_of_week')} AS day_name, a AS avg_volume FROM by_day"),
    "a3_mean_by_month": sql("SELECT month, a AS avg_volume FROM by_month"),
    "a4_mean_by_weather": sql("SELECT weather_main, a AS avg_volume FROM by_weather"),
    "a5_conditional_means": sql("SELECT weekend_avg, weekday_avg, holiday_avg, rush_avg FROM sides"),
    "a6_peak_profile": sql(f"""SELECT 'hourly_avg' AS metric, CAST(hour AS VARCHAR) AS key, a AS value FROM by_hour
        UNION ALL SELECT 'daily_avg', {day_short('day_of_week')}, a FROM by_day
        UNION ALL SELECT 'monthly_avg', CAST(month AS VARCHAR), a FROM by_month
        UNION ALL SELECT 'weather_impact', weather_main, a FROM by_weather"""),
    "a6_peak_summary": sql("SELECT * FROM peak"),
    "a7_dataset_statistics": sql("""SELECT t.*, peak_hour, trough_hour, peak_day, weekday_avg, weekend_avg, holiday_avg, rush_avg
        FROM peak, (SELECT count(*) AS total_records, CAST(min(date_time) AS DATE) AS start_date,
        CAST(max(date_time) AS DATE) AS end_date, CAST(count(DISTINCT year) AS INTEGER) AS years_covered,
        round(avg(traffic_volume), 1) AS avg_volume, median(traffic_volume) AS median_volume,
        max(traffic_volume) AS max_volume, min(traffic_volume) AS min_volume FROM lab) t"""),
    "a8_class_distribution": sql(f"""SELECT c AS congestion_code, {label('c')} AS congestion_label, count(obs_id) AS n,
        round(count(obs_id) / (SELECT count(*) FROM lab) * 100, 1) AS pct
        FROM codes LEFT JOIN lab ON congestion_code = c GROUP BY c"""),
    "a9_rush_statistics": sql("""SELECT 7 AS morning_start, 9 AS morning_end, 16 AS evening_start, 18 AS evening_end,
        rush_avg, weekday_avg, weekend_avg, holiday_avg,
        round((rush_avg - weekday_avg) / greatest(weekday_avg, 1) * 100, 1) AS rush_premium_pct FROM sides"""),
    "a10_weekday_weekend": sql(f"""SELECT weekday_avg, weekend_avg,
        round((weekday_avg - weekend_avg) / greatest(weekday_avg, 1) * 100, 1) AS diff_pct,
        {_hour_side(0)} AS peak_weekday_hour, {_hour_side(1)} AS peak_weekend_hour FROM sides"""),
    "a11_data_profile": sql("""SELECT count(*) AS total_records, CAST(min(date_time) AS DATE) AS date_range_start,
        CAST(max(date_time) AS DATE) AS date_range_end, CAST(count(DISTINCT year) AS INTEGER) AS years_covered,
        count(*) FILTER (WHERE congestion_code = 0) AS low_count, count(*) FILTER (WHERE congestion_code = 1) AS medium_count,
        count(*) FILTER (WHERE congestion_code = 2) AS high_count, count(*) FILTER (WHERE congestion_code = 3) AS severe_count,
        count(*) FILTER (WHERE traffic_volume = 0) AS zero_readings,
        CASE WHEN count(*) FILTER (WHERE traffic_volume = 0) > 0
          THEN count(*) FILTER (WHERE traffic_volume = 0) || ' zero-volume readings detected.' END AS anomaly,
        round(count(*) FILTER (WHERE congestion_code = 3 AND is_rush_hour = 1)
          / greatest(count(*) FILTER (WHERE congestion_code = 3), 1) * 100, 1) AS severe_during_rush_pct FROM lab"""),
    "a12_volume_heatmap": _pivot("traffic_volume", 0),
    "a13_congestion_heatmap": _pivot("congestion_code", 2),
    "a14_daily_calendar": sql("SELECT 1").removesuffix("SELECT 1").rstrip() + _CALENDAR + "(SELECT y FROM usual)",
    "a14_calendar_of_year": sql("SELECT 1").removesuffix("SELECT 1").rstrip() + _CALENDAR + "2024",
    "a15_years": sql("SELECT DISTINCT year FROM lab"),
    "a16_weather_box": sql("""SELECT l.weather_main, count(*) AS n_rows, any_value(q.q1) AS q1, any_value(q.q2) AS median,
        any_value(q.q3) AS q3, round(avg(traffic_volume), 4) AS mean, min(traffic_volume) AS min, max(traffic_volume) AS max,
        min(traffic_volume) FILTER (WHERE traffic_volume >= q.q1 - 1.5 * (q.q3 - q.q1)) AS whisker_low,
        max(traffic_volume) FILTER (WHERE traffic_volume <= q.q3 + 1.5 * (q.q3 - q.q1)) AS whisker_high,
        count(*) FILTER (WHERE traffic_volume < q.q1 - 1.5 * (q.q3 - q.q1) OR traffic_volume > q.q3 + 1.5 * (q.q3 - q.q1)) AS n_outliers
        FROM lab l JOIN (SELECT weather_main, quantile_cont(traffic_volume, 0.25) AS q1, quantile_cont(traffic_volume, 0.5) AS q2,
          quantile_cont(traffic_volume, 0.75) AS q3 FROM lab GROUP BY 1) q ON l.weather_main = q.weather_main GROUP BY 1"""),
    "a17_rain_sample": sql("""SELECT obs_id, rain_1h, traffic_volume, congestion_label FROM lab WHERE rain_1h > 0
        ORDER BY md5('42-' || obs_id), obs_id LIMIT 3000"""),
    "a18_temperature_profile": sql("""SELECT CAST(lo AS INTEGER) AS bin_low, '(' || lo || ', ' || (lo + 5) || ']' AS temp_bin,
        round(avg(traffic_volume), 6) AS avg_volume FROM lab JOIN (SELECT range AS lo FROM range(-30, 40, 5)) b
        ON temp_celsius > lo AND temp_celsius <= lo + 5 GROUP BY lo"""),
    "a19_severity_profile": sql(f"""SELECT s.severity, {_SEVERITY} AS severity_label, round(avg(traffic_volume), 6) AS avg_volume
        FROM (SELECT CAST(range AS INTEGER) AS severity FROM range(5)) s
        LEFT JOIN lab ON s.severity = least(weather_severity, 4) GROUP BY 1"""),
    "a20_weekday_weekend_by_hour": sql("""SELECT hour, round(avg(traffic_volume) FILTER (WHERE is_weekend = 0), 6) AS weekday_avg,
        round(avg(traffic_volume) FILTER (WHERE is_weekend = 1), 6) AS weekend_avg FROM lab GROUP BY 1"""),
    "a21_weekday_weekend_by_month": sql(f"""SELECT m.month, {month_short('m.month')} AS month_name,
        coalesce(round(avg(traffic_volume) FILTER (WHERE is_weekend = 0), 0), 0) AS weekday_avg,
        coalesce(round(avg(traffic_volume) FILTER (WHERE is_weekend = 1), 0), 0) AS weekend_avg
        FROM (SELECT CAST(range AS INTEGER) AS month FROM range(1, 13)) m LEFT JOIN lab ON lab.month = m.month GROUP BY 1"""),
    "a22_peak_months": sql(f"""SELECT *, {month_short('weekday_peak_month')} AS weekday_peak_name,
        {month_short('weekend_peak_month')} AS weekend_peak_name
        FROM (SELECT {_month_side(0)} AS weekday_peak_month, {_month_side(1)} AS weekend_peak_month)"""),
    "a23_class_share_by_hour": sql("SELECT hour, " + ", ".join(
        f"round(count(*) FILTER (WHERE congestion_code = {i}) / count(*) * 100, 4) AS {n.lower()}"
        for i, n in enumerate(V.CONGESTION_LABELS)) + " FROM lab GROUP BY 1"),
    "a24_weather_extremes": sql("""SELECT (SELECT weather_main FROM w ORDER BY a DESC, weather_main LIMIT 1) AS best_weather,
        CAST(max(a) AS BIGINT) AS best_avg, (SELECT weather_main FROM w ORDER BY a, weather_main LIMIT 1) AS worst_weather,
        CAST(min(a) AS BIGINT) AS worst_avg, CAST(coalesce(max(a) FILTER (WHERE weather_main = 'Clear'), 0)
        - coalesce(max(a) FILTER (WHERE weather_main = 'Squall'), min(a)) AS BIGINT) AS clear_gap
        FROM (SELECT * FROM w)""").replace("by_hour AS", "w AS (SELECT weather_main, round(avg(traffic_volume), 0) AS a FROM lab GROUP BY 1),\nby_hour AS", 1),
    "a25_wet_dry": sql("""SELECT count(*) FILTER (WHERE rain_1h > 0) AS rainy_rows,
        round(count(*) FILTER (WHERE rain_1h > 0) / count(*) * 100, 1) AS rainy_pct,
        CAST(trunc(avg(traffic_volume) FILTER (WHERE rain_1h > 0)) AS BIGINT) AS wet_avg,
        CAST(trunc(avg(traffic_volume) FILTER (WHERE rain_1h = 0)) AS BIGINT) AS dry_avg FROM lab"""),
    "a26_median_lags_by_hour": sql("SELECT hour, " + ", ".join(
        _LAG_COLS.format(a=a, b=b) for a, b in zip(("l1", "l24", "r3", "r6"), A.LAGS)) + " FROM lag_hours"),
    "a27_rush_schedule": sql(_SCHEDULE),
    "j5_complete_hours": sql("SELECT hour, " + ", ".join(_LAG_COLS.format(a=c, b=c) for c in A.LAGS) + " FROM lag_table"),
    "j6_severity_dimension": sql(f"""SELECT s.severity, {_SEVERITY} AS severity_label, CAST(count(obs_id) = 0 AS INTEGER) AS is_empty
        FROM (SELECT CAST(range AS INTEGER) AS severity FROM range(5)) s
        LEFT JOIN lab l ON s.severity = least(weather_severity, 4) GROUP BY 1"""),
}
