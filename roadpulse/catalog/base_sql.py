"""Common table expressions of the checking SQL, written against the given tables."""

from __future__ import annotations

from roadpulse import fixed_values as V


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(expr: str, pairs: dict, default: str = "NULL") -> str:
    lit = lambda x: text(x) if isinstance(x, str) else str(x)
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in pairs.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def label(code: str) -> str:
    return case(code, dict(enumerate(V.CONGESTION_LABELS)))


def day_short(dow: str) -> str:
    return case(dow, dict(enumerate(V.DAYS_SHORT)))


def day_long(dow: str) -> str:
    return case(dow, dict(enumerate(V.DAYS_LONG)))


def month_short(m: str) -> str:
    return case(m, dict(enumerate(V.MONTHS_SHORT, start=1)))


def congestion(v: str) -> str:
    return (
        f"CASE WHEN {v} < 0 OR {v} > 7300 THEN NULL WHEN {v} <= 1000 THEN 0 WHEN {v} <= 2500 THEN 1 "
        f"WHEN {v} <= 4500 THEN 2 ELSE 3 END"
    )


def nearest(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN {v} <= 1000 THEN 0 WHEN {v} <= 2500 THEN 1 WHEN {v} <= 4500 THEN 2 ELSE 3 END"


def segment(code: str, factor: str) -> str:
    x = f"({code} * {factor})"
    return f"CASE WHEN {x} < 0.5e0 THEN 0 WHEN {x} < 1.5e0 THEN 1 WHEN {x} < 2.5e0 THEN 2 ELSE 3 END"


WEATHER = case("weather_main", V.WEATHER_CODES, "2")
RUSH_COLUMNS = """
  CAST(hour BETWEEN 7 AND 9 AS INTEGER) AS is_morning_rush,
  CAST(hour BETWEEN 16 AND 18 AS INTEGER) AS is_evening_rush,
  CAST(hour BETWEEN 7 AND 9 OR hour BETWEEN 16 AND 18 AS INTEGER) AS is_rush_hour,
  CAST(CASE WHEN hour BETWEEN 7 AND 9 THEN 1 WHEN hour BETWEEN 16 AND 18 THEN 2 ELSE 0 END AS INTEGER) AS rush_type"""
CYCLES = """
  round(sin(2 * pi() * hour / 24), 9) AS hour_sin, round(cos(2 * pi() * hour / 24), 9) AS hour_cos,
  round(sin(2 * pi() * month / 12), 9) AS month_sin, round(cos(2 * pi() * month / 12), 9) AS month_cos"""


def _lags(window: str) -> str:
    return f"""
  coalesce(CAST(lag(traffic_volume, 1) OVER ({window}) AS DOUBLE), med) AS traffic_lag_1h,
  coalesce(CAST(lag(traffic_volume, 24) OVER ({window}) AS DOUBLE), med) AS traffic_lag_24h,
  coalesce(avg(traffic_volume) OVER ({window} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), med) AS traffic_rolling_3h,
  coalesce(avg(traffic_volume) OVER ({window} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), med) AS traffic_rolling_6h"""


FACTORS = (0.70, 0.80, 1.10, 1.40, 1.50, 1.20, 1.05, 0.95, 0.85, 1.00, 0.90, 1.00, 1.15, 1.30, 1.10, 0.75)

CTES = f"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
named AS (SELECT *,
  CASE WHEN k = 90 THEN 'Squall' WHEN k = 20 THEN 'Haze' WHEN k = 21 THEN 'Smoke' WHEN k = 22 THEN 'Drizzle'
       WHEN k = 23 THEN 'Mist' WHEN k = 24 THEN 'Fog' WHEN k = 25 THEN 'Thunderstorm' WHEN event_type = 'view' THEN 'Clear' WHEN event_type = 'click' THEN 'Clouds'
       WHEN event_type = 'purchase' THEN 'Rain' WHEN event_type = 'signup' THEN 'Snow'
       WHEN event_type = 'error' THEN 'Tornado' END AS weather_main FROM ev),
bound AS (SELECT event_id AS obs_id, user_id, user_id % 8 AS sensor_id,
  make_timestamp(CAST(1640995200000000 + 36 * (epoch_us(ts) - 1704067200000000) AS BIGINT)) AS date_time,
  CAST(floor(value * 30) AS INTEGER) AS traffic_volume,
  CASE WHEN event_id % 97 = 0 THEN 0e0 ELSE 253.15e0 + 0.5e0 * k END AS temp,
  CASE WHEN k >= 95 THEN 60e0 WHEN k = 76 THEN 7.6e0 WHEN k > 60 THEN 0.25e0 * (k - 60) ELSE 0e0 END AS rain_1h,
  CASE WHEN event_type = 'signup' AND k < 50 THEN 0.125e0 ELSE 0e0 END AS snow_1h,
  k AS clouds_all, weather_main, lower(weather_main) AS weather_description,
  CASE WHEN day(ts) IN (1, 15) THEN 'Holiday' END AS holiday FROM named),
raw AS (SELECT * EXCLUDE (user_id) FROM bound UNION ALL
        SELECT * EXCLUDE (user_id) FROM bound WHERE obs_id % 50 = 0),
uniq AS (SELECT DISTINCT * FROM raw),
hour_median AS (SELECT hour(date_time) AS h, median(temp) AS m FROM uniq GROUP BY 1),
cleaned AS (SELECT obs_id, sensor_id, date_time, traffic_volume,
  CASE WHEN temp = 0 THEN m ELSE temp END AS temp,
  CASE WHEN rain_1h > 50 THEN 50e0 ELSE rain_1h END AS rain_1h, snow_1h, clouds_all, weather_main,
  weather_description, coalesce(holiday, 'None') AS holiday
  FROM uniq LEFT JOIN hour_median ON hour(date_time) = h),
timed AS (SELECT *, CAST(hour(date_time) AS INTEGER) AS hour, CAST(isodow(date_time) - 1 AS INTEGER) AS day_of_week,
  CAST(month(date_time) AS INTEGER) AS month, CAST(year(date_time) AS INTEGER) AS year,
  CAST(dayofyear(date_time) AS INTEGER) AS day_of_year FROM cleaned),
feat AS (SELECT *, CAST(day_of_week >= 5 AS INTEGER) AS is_weekend, {RUSH_COLUMNS}, {CYCLES},
  CAST(holiday <> 'None' AS INTEGER) AS is_holiday, temp - 273.15e0 AS temp_celsius,
  CAST(rain_1h > 0 AS INTEGER) AS is_raining, CAST(snow_1h > 0 AS INTEGER) AS is_snowing,
  CAST(CASE WHEN rain_1h <= -0.1e0 OR rain_1h > 55 THEN NULL WHEN rain_1h <= 0 THEN 0 WHEN rain_1h <= 2.5e0 THEN 1
       WHEN rain_1h <= 7.6e0 THEN 2 ELSE 3 END + CAST(snow_1h > 0 AS INTEGER) AS DOUBLE) AS weather_severity,
  CAST({WEATHER} AS DOUBLE) AS weather_code,
  CAST({congestion('traffic_volume')} AS INTEGER) AS congestion_code FROM timed),
lab AS (SELECT *, {label('congestion_code')} AS congestion_label FROM feat WHERE congestion_code IS NOT NULL),
med AS (SELECT median(traffic_volume) AS med FROM uniq),
lagged AS (SELECT feat.*, {label('congestion_code')} AS congestion_label, {_lags('ORDER BY date_time, obs_id')}
  FROM feat, med),
lagged_sensor AS (SELECT feat.*, {_lags('PARTITION BY sensor_id ORDER BY date_time, obs_id')} FROM feat, med),
hist AS (SELECT * FROM lagged WHERE congestion_code IS NOT NULL),
cond AS (SELECT obs_id AS scenario_id, user_id * 2 // 3 // 16 AS corridor_id, date_time, CAST(date_time AS DATE) AS as_of,
  CAST(hour(date_time) AS INTEGER) AS hour, CAST(isodow(date_time) - 1 AS INTEGER) AS day_of_week,
  CAST(month(date_time) AS INTEGER) AS month, 0.5e0 * clouds_all - 20 AS temp_celsius,
  CASE WHEN rain_1h > 50 THEN 50e0 ELSE rain_1h END AS rain_1h, snow_1h, clouds_all, weather_main,
  CAST(holiday IS NOT NULL AS INTEGER) AS is_holiday, CAST(traffic_volume AS DOUBLE) AS traffic_lag_1h FROM bound),
cfeat AS (SELECT *, CAST(year(as_of) AS INTEGER) AS year, CAST(dayofyear(as_of) AS INTEGER) AS day_of_year,
  CAST(day_of_week >= 5 AS INTEGER) AS is_weekend, {RUSH_COLUMNS}, {CYCLES},
  CAST(rain_1h > 0 AS INTEGER) AS is_raining, CAST(snow_1h > 0 AS INTEGER) AS is_snowing,
  CAST(CASE WHEN rain_1h = 0 THEN 0 WHEN rain_1h < 2.5e0 THEN 1 WHEN rain_1h < 7.6e0 THEN 2 ELSE 3 END
       + CAST(snow_1h > 0 AS INTEGER) AS DOUBLE) AS weather_severity,
  CAST({WEATHER} AS DOUBLE) AS weather_code,
  traffic_lag_1h * 0.95e0 AS traffic_lag_24h, traffic_lag_1h * 0.98e0 AS traffic_rolling_3h,
  traffic_lag_1h * 0.96e0 AS traffic_rolling_6h FROM cond),
scored AS (SELECT *, CAST({nearest('traffic_lag_1h')} AS INTEGER) AS pred_code FROM cfeat),
pred AS (SELECT *, {label('pred_code')} AS label FROM scored),
lag_hours AS (SELECT hour, median(traffic_lag_1h) AS l1, median(traffic_lag_24h) AS l24,
  median(traffic_rolling_3h) AS r3, median(traffic_rolling_6h) AS r6 FROM hist GROUP BY hour),
hours24 AS (SELECT CAST(range AS INTEGER) AS hour FROM range(24)),
lag_table AS (SELECT h.hour, coalesce(l1, (SELECT median(l1) FROM lag_hours)) AS traffic_lag_1h,
  coalesce(l24, (SELECT median(l24) FROM lag_hours)) AS traffic_lag_24h,
  coalesce(r3, (SELECT median(r3) FROM lag_hours)) AS traffic_rolling_3h,
  coalesce(r6, (SELECT median(r6) FROM lag_hours)) AS traffic_rolling_6h
  FROM hours24 h LEFT JOIN lag_hours l ON h.hour = l.hour),
risk AS (SELECT c.scenario_id, c.corridor_id, t.hour, CAST({nearest('t.traffic_lag_1h')} AS INTEGER) AS code
  FROM cond c CROSS JOIN lag_table t),
segs AS (SELECT s_suppkey // 16 AS corridor_id, CAST(s_suppkey % 16 AS INTEGER) AS ordinal, s_name AS name,
  'Exit ' || s_nationkey AS exit,
  CAST(list_extract([{', '.join(f'{f}e0' for f in FACTORS)}], CAST(s_suppkey % 16 AS INTEGER) + 1) AS DOUBLE) AS factor,
  round(44e0 + (s_suppkey * 3 + 1) * 0.001e0, 4) AS lat_center,
  round(-93e0 + (s_suppkey * 3 + 1) * 0.002e0, 4) AS lon_center FROM supplier),
state AS (SELECT p.scenario_id, p.corridor_id, p.pred_code AS base_code, p.label AS base_label, s.ordinal, s.name, s.exit,
  s.factor, s.lat_center, s.lon_center, s.factor > 1 AS is_bottleneck,
  CAST({segment('p.pred_code', 's.factor')} AS INTEGER) AS segment_code
  FROM pred p JOIN segs s ON p.corridor_id = s.corridor_id),
seg_state AS (SELECT *, {label('segment_code')} AS segment_label,
  {case(label('segment_code'), V.LEVEL_COLORS)} AS color_hex FROM state),
by_hour AS (SELECT hour, round(avg(traffic_volume), 1) AS a FROM lab GROUP BY 1),
by_day AS (SELECT day_of_week, round(avg(traffic_volume), 1) AS a FROM lab GROUP BY 1),
by_month AS (SELECT month, round(avg(traffic_volume), 1) AS a FROM lab GROUP BY 1),
by_weather AS (SELECT weather_main, round(avg(traffic_volume), 1) AS a FROM lab GROUP BY 1),
sides AS (SELECT
  round(avg(traffic_volume) FILTER (WHERE is_weekend = 1), 1) AS weekend_avg,
  round(avg(traffic_volume) FILTER (WHERE is_weekend = 0), 1) AS weekday_avg,
  round(coalesce(avg(traffic_volume) FILTER (WHERE is_holiday = 1), 0), 1) AS holiday_avg,
  round(avg(traffic_volume) FILTER (WHERE is_rush_hour = 1), 1) AS rush_avg FROM lab),
peak AS (SELECT
  (SELECT hour FROM by_hour ORDER BY a DESC, hour LIMIT 1) AS peak_hour,
  (SELECT hour FROM by_hour ORDER BY a, hour LIMIT 1) AS trough_hour,
  (SELECT {day_short('day_of_week')} FROM by_day ORDER BY a DESC, day_of_week LIMIT 1) AS peak_day,
  (SELECT month FROM by_month ORDER BY a DESC, month LIMIT 1) AS worst_month, sides.*,
  (SELECT weather_main FROM by_weather ORDER BY a DESC, weather_main LIMIT 1) AS top_weather,
  (SELECT max(a) FROM by_weather) AS top_weather_avg,
  (SELECT weather_main FROM by_weather ORDER BY a, weather_main DESC LIMIT 1) AS low_weather,
  (SELECT min(a) FROM by_weather) AS low_weather_avg FROM sides),
three AS (
  SELECT 'persistence' AS model, congestion_code AS actual, CAST({nearest('traffic_lag_1h')} AS INTEGER) AS predicted FROM hist
  UNION ALL SELECT 'same_row_yesterday', congestion_code, CAST({nearest('traffic_lag_24h')} AS INTEGER) FROM hist
  UNION ALL SELECT 'trailing_mean', congestion_code, CAST({nearest('traffic_rolling_3h')} AS INTEGER) FROM hist),
codes AS (SELECT CAST(range AS INTEGER) AS c FROM range(4)),
conf AS (SELECT m.model, a.c AS actual, b.c AS predicted,
  count(t.model) AS n FROM (SELECT DISTINCT model FROM three) m CROSS JOIN codes a CROSS JOIN codes b
  LEFT JOIN three t ON t.model = m.model AND t.actual = a.c AND t.predicted = b.c GROUP BY 1, 2, 3),
marg AS (SELECT model, c, CAST(sum(CASE WHEN actual = c AND predicted = c THEN n ELSE 0 END) AS DOUBLE) AS hit,
  CAST(sum(CASE WHEN actual = c THEN n ELSE 0 END) AS DOUBLE) AS support,
  CAST(sum(CASE WHEN predicted = c THEN n ELSE 0 END) AS DOUBLE) AS claimed FROM conf, codes GROUP BY 1, 2),
ratio AS (SELECT *, CASE WHEN claimed > 0 THEN hit / claimed ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM marg),
rep AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
  FROM ratio),
summ AS (SELECT model, round(sum(hit) / sum(support), 4) AS accuracy,
  round(sum(f1 * support) / sum(support), 4) AS f1_weighted FROM rep GROUP BY 1)
"""


def sql(query: str) -> str:
    return f"WITH {CTES.strip()}\n{query.strip()}"
