"""Sorting, arg-max over groups, and bounded top-k reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.functions import columns as C

PREVIEW = (
    "date_time", "traffic_volume", "congestion_label", "hour",
    "is_rush_hour", "is_weekend", "weather_main", "temp_celsius", "rain_1h",
)


def by_time(df: DataFrame, ts: str = "date_time", tie: str = "obs_id") -> DataFrame:
    return df.orderBy(ts, tie)


def first_max(value: Column, key: Column) -> Column:
    """Aggregate: the key of the largest value, the smallest key on ties. Numeric keys."""
    return -F.max(F.when(value.isNotNull(), F.struct(value.alias("v"), (-key).alias("k"))))["k"]


def first_min(value: Column, key: Column) -> Column:
    """Aggregate: the key of the smallest value, the smallest key on ties."""
    return F.min(F.when(value.isNotNull(), F.struct(value.alias("v"), key.alias("k"))))["k"]


def ranked(df: DataFrame, metric: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(metric), F.asc(key))


def top_k(df: DataFrame, k: int, metric: str, key: str) -> DataFrame:
    return df.transform(ranked, metric, key).limit(k)


def preview(df: DataFrame, rows: int = 200, tie: str = "obs_id") -> DataFrame:
    """The first rows in time order, selected columns: a top-k, not a full sort."""
    return df.orderBy("date_time", tie).select(*PREVIEW).limit(rows)


def by_priority(df: DataFrame, column: str = "priority", then: str = "ordinal") -> DataFrame:
    return df.orderBy(C.lookup(V.PRIORITY_ORDER, F.col(column), len(V.PRIORITY_ORDER)), then)


def seeded_sample(df: DataFrame, rows: int, seed: int, key: str) -> DataFrame:
    """A repeatable sample without replacement: the rows with the smallest seeded hashes."""
    return df.orderBy(seeded_hash(seed, key), key).limit(rows)


def seeded_hash(seed: int | str, *keys: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
