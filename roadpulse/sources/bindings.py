"""The given tables bound to observations, conditions and corridor segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.operators.cleaning import cap, fill_holiday
from roadpulse.operators.features import calendar_features, holiday_feature

FACTORS = (0.70, 0.80, 1.10, 1.40, 1.50, 1.20, 1.05, 0.95, 0.85, 1.00, 0.90, 1.00, 1.15, 1.30, 1.10, 0.75)
SEGMENTS_PER_CORRIDOR = 16
RARE_WEATHER = ("Haze", "Smoke", "Drizzle", "Mist", "Fog", "Thunderstorm")
STRETCH = 36  # one month of events becomes three years of observations


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _bound_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    names = {"view": "Clear", "click": "Clouds", "purchase": "Rain", "signup": "Snow", "error": "Tornado"}
    weather = F.when(k == 90, "Squall")
    for i, name in enumerate(RARE_WEATHER):
        weather = weather.when(k == 20 + i, name)
    for event, name in names.items():
        weather = weather.when(F.col("event_type") == event, name)
    stretched = F.expr(
        f"timestamp_ntz'2022-01-01 00:00:00' + (ts - timestamp_ntz'2024-01-01 00:00:00') * {STRETCH}"
    )
    return e.select(
        F.col("event_id").alias("obs_id"),
        "user_id",
        (F.col("user_id") % 8).alias("sensor_id"),
        stretched.alias("date_time"),
        F.floor(F.col("value") * 30).cast("int").alias("traffic_volume"),
        F.when(F.col("event_id") % 97 == 0, 0.0).otherwise(253.15 + 0.5 * k).alias("temp"),
        F.when(k >= 95, 60.0).when(k == 76, 7.6).when(k > 60, 0.25 * (k - 60)).otherwise(0.0).alias("rain_1h"),
        F.when((F.col("event_type") == "signup") & (k < 50), 0.125).otherwise(0.0).alias("snow_1h"),
        k.alias("clouds_all"),
        weather.alias("weather_main"),
        F.lower(weather).alias("weather_description"),
        F.when(F.dayofmonth("ts").isin(1, 15), "Holiday").alias("holiday"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw observations from `events`: one scan, every 50th row emitted twice as an exact copy."""
    copies = F.when(F.col("obs_id") % 50 == 0, 2).otherwise(1)
    return (
        _bound_events(spark, sf_dir)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
        .drop("_copy", "user_id")
    )


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One condition row per event; its last known volume is the event's own volume."""
    return (
        _bound_events(spark, sf_dir)
        .transform(cap).transform(fill_holiday).transform(calendar_features).transform(holiday_feature)
        .select(
            F.col("obs_id").alias("scenario_id"),
            F.floor(F.col("user_id") * 2 / 3 / SEGMENTS_PER_CORRIDOR).alias("corridor_id"),
            "date_time",
            F.to_date("date_time").alias("as_of"),
            "hour", "day_of_week", "month",
            (0.5 * F.col("clouds_all") - 20).alias("temp_celsius"),
            "rain_1h", "snow_1h", "clouds_all", "weather_main", "is_holiday",
            F.col("traffic_volume").cast("double").alias("traffic_lag_1h"),
        )
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corridors of up to 16 segments from `supplier`, in key order."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    ordinal = (key % SEGMENTS_PER_CORRIDOR).cast("int")
    factor = F.element_at(F.array(*[F.lit(f) for f in FACTORS]), ordinal + 1)
    point = lambda d: F.array(
        F.round(F.lit(44.0) + (key * 3 + d) * 0.001, 4), F.round(F.lit(-93.0) + (key * 3 + d) * 0.002, 4)
    )
    return s.select(
        F.floor(key / SEGMENTS_PER_CORRIDOR).alias("corridor_id"),
        ordinal.alias("ordinal"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("Exit "), F.col("s_nationkey").cast("string")).alias("exit"),
        factor.alias("factor"),
        F.array(point(0), point(1), point(2)).alias("coords"),
    )
