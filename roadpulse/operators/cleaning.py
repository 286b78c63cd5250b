"""Cleaning: de-duplication, sentinel repair, caps, null fills, predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.operators.quantiles import exact_quantiles


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One row per distinct row, nulls equal. Map-side aggregation folds hot copies before the shuffle."""
    return df.dropDuplicates()


def hourly_medians(df: DataFrame, column: str, ts: str = "date_time", continuous: bool = False) -> DataFrame:
    """Exact median per hour of day: at most 24 rows. Equal values are counted first, so the
    median itself runs over distinct values only and no raw group reaches one task. Readings with few digits have few
    distinct values; for `continuous` ones the median is selected by bits, and no task holds the distinct values of an hour."""
    if continuous:
        hours = df.select(F.hour(ts).alias("_hour"), column)
        return exact_quantiles(hours, column, [0.5], ["_hour"]).select("_hour", F.col("quantiles")[0].alias("_median"))
    counted = df.groupBy(F.hour(ts).alias("_hour"), F.col(column).alias("_v")).count()
    return counted.groupBy("_hour").agg(F.percentile("_v", 0.5, F.col("count")).alias("_median"))


def repair_zero_temperature(df: DataFrame, ts: str = "date_time", continuous: bool = False) -> DataFrame:
    """Zero readings take the median of their hour over all rows, zeros included."""
    hour = F.col("_hour")
    entry = F.when(hour.isNotNull(), F.struct(hour, F.col("_median")))
    # 24 entries at most, as a scalar subquery: no join, and the de-duplicated rows are shuffled once.
    medians = hourly_medians(df, "temp", ts, continuous).agg(F.map_from_entries(F.collect_list(entry))).scalar()
    return df.withColumn("temp", F.when(F.col("temp") == 0, medians[F.hour(ts)]).otherwise(F.col("temp")))


def cap(df: DataFrame, column: str = "rain_1h", upper: float = V.RAIN_CAP) -> DataFrame:
    c = F.col(column)
    return df.withColumn(column, F.when(c > upper, F.lit(upper)).otherwise(c))


def fill_holiday(df: DataFrame) -> DataFrame:
    return df.withColumn("holiday", F.coalesce("holiday", F.lit("None")))


def clean(df: DataFrame) -> DataFrame:
    return (
        df.transform(drop_exact_duplicates)
        .transform(repair_zero_temperature)
        .transform(cap)
        .transform(fill_holiday)
    )


def drop_unlabelled(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["congestion_code"])


def zero_volume_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("traffic_volume") == 0).alias("zero_readings"))


def severe_in_rush(df: DataFrame) -> DataFrame:
    return df.where((F.col("congestion_label") == "Severe") & (F.col("is_rush_hour") == 1))


def in_period(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.where(F.col(column).between(low, high))
