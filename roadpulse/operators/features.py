"""Feature columns for history rows and for condition rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.functions import columns as C
from roadpulse.operators.series import lag_features


def calendar_features(df: DataFrame, ts: str = "date_time") -> DataFrame:
    t = F.col(ts)
    dow = F.weekday(t)
    return df.withColumns({
        "hour": F.hour(t),
        "day_of_week": dow,
        "month": F.month(t),
        "year": F.year(t),
        "day_of_year": F.dayofyear(t),
        "is_weekend": C.flag(dow >= 5),
    })


def rush_features(df: DataFrame) -> DataFrame:
    return df.withColumns(C.rush_columns(F.col("hour")))


def cyclic_features(df: DataFrame) -> DataFrame:
    return df.withColumns(C.cycle_columns(F.col("hour"), F.col("month")))


def holiday_feature(df: DataFrame) -> DataFrame:
    return df.withColumn("is_holiday", C.flag(F.col("holiday") != "None"))


def weather_features(df: DataFrame, edge: str = "train") -> DataFrame:
    rain, snow = F.col("rain_1h"), F.col("snow_1h")
    return df.withColumns({
        "temp_celsius": F.col("temp") - 273.15,
        "is_raining": C.flag(rain > 0),
        "is_snowing": C.flag(snow > 0),
        "weather_severity": C.weather_severity(rain, snow, edge),
        "weather_code": C.weather_code(F.col("weather_main")),
    })


def label_congestion(df: DataFrame, volume: str = "traffic_volume", bins=V.CONGESTION_BINS) -> DataFrame:
    return df.withColumn("congestion_code", C.congestion_code(F.col(volume), bins)).withColumn(
        "congestion_label", C.level_label(F.col("congestion_code"))
    )


def row_features(df: DataFrame, edge: str = "train") -> DataFrame:
    """Every feature that needs only its own row: a single projection, no shuffle."""
    return (
        df.transform(calendar_features)
        .transform(rush_features)
        .transform(cyclic_features)
        .transform(holiday_feature)
        .transform(weather_features, edge)
    )


def engineer(df: DataFrame, keys=(), tie: str = "obs_id", **series) -> DataFrame:
    return df.transform(row_features).transform(lag_features, keys=keys, tie=tie, **series)


def feature_matrix(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*extra, *V.FEATURES)


# --- condition rows ---------------------------------------------------------------------

_DEFAULTS = {"snow_1h": 0.0, "clouds_all": 40, "weather_main": "Clear", "is_holiday": 0}


def default_lags(df: DataFrame) -> DataFrame:
    """Unknown lags follow from the last known volume."""
    last = F.col("traffic_lag_1h")
    have = set(df.columns)

    def known(name: str, share: float) -> Column:
        derived = last * F.lit(share)
        return F.coalesce(name, derived) if name in have else derived

    return df.withColumns({
        "traffic_lag_24h": known("traffic_lag_24h", V.LAG_24H_SHARE),
        "traffic_rolling_3h": known("traffic_rolling_3h", V.ROLLING_3H_SHARE),
        "traffic_rolling_6h": known("traffic_rolling_6h", V.ROLLING_6H_SHARE),
    })


def condition_features(df: DataFrame, edge: str = "serve") -> DataFrame:
    """The full feature row of a condition. Year and day of year come from `as_of`, never from a clock.

    A `weather_code` column that is already present wins over `weather_main`.
    """
    have = set(df.columns)
    filled = {c: F.coalesce(c, F.lit(v)) if c in have else F.lit(v) for c, v in _DEFAULTS.items()}
    df = df.withColumns(filled).transform(default_lags)
    hour, dow, rain, snow = (F.col(c) for c in ("hour", "day_of_week", "rain_1h", "snow_1h"))
    code = C.weather_code(F.col("weather_main"))
    return df.withColumns({
        "year": F.year("as_of"),
        "day_of_year": F.dayofyear("as_of"),
        "is_weekend": C.flag(dow >= 5),
        **C.rush_columns(hour),
        **C.cycle_columns(hour, F.col("month")),
        "is_raining": C.flag(rain > 0),
        "is_snowing": C.flag(snow > 0),
        "weather_severity": C.weather_severity(rain, snow, edge),
        "weather_code": F.coalesce("weather_code", code) if "weather_code" in have else code,
    })
