"""Reading and writing observation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.schema import OBSERVATION

LINE, FAULT = "_line", "_fault"


def read_observations(spark: SparkSession, path: str, extra: str | None = None, time_format: str | None = None) -> DataFrame:
    """Observation CSV with a header. `extra` adds leading columns such as `obs_id long`.
    The time column is read as text and parsed explicitly; empty fields are null."""
    columns = list(T.StructType.fromDDL(extra).fields) if extra else []
    columns += [
        T.StructField(f.name, T.StringType()) if f.name == "date_time" else f for f in OBSERVATION.fields
    ]
    raw = spark.read.schema(T.StructType(columns)).option("header", True).option("nullValue", "").csv(path)
    fmt = [F.lit(time_format)] if time_format else []
    return raw.withColumn("date_time", F.to_timestamp_ntz("date_time", *fmt))


def _parsed_time(text: Column, time_format: str | None) -> Column:
    """Wall-clock time of a text, null where it isn't one; no zone of the session takes part."""
    if time_format is None:
        return text.try_cast("timestamp_ntz")
    instant = F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(f"{time_format}X"))
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def split_observations(
    spark: SparkSession, path: str, extra: str | None = None, time_format: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Observation CSV with a header as (rows, rejected): broken lines end no job and are not lost.

    `rows` has the columns of `read_observations`. `rejected` has (text, reason): the line and `fields` where
    the number of fields is wrong, else the first column whose value isn't of its type; a line with the right number
    of fields is given as its fields written anew. Empty fields are null and no fault. Empty lines count as neither.
    """
    leading = list(T.StructType.fromDDL(extra).fields) if extra else []
    columns = [*leading, *OBSERVATION.fields]
    texts = T.StructType([*(T.StructField(f.name, T.StringType()) for f in columns), T.StructField(LINE, T.StringType())])
    # unused columns are parsed too: otherwise the number of fields would go unnoticed where a plan needs few of them
    raw = (
        spark.read.schema(texts).option("header", True).option("nullValue", "").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", LINE).option("columnPruning", False).csv(path)
    )
    value = {
        f.name: _parsed_time(F.col(f.name), time_format) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name).try_cast(f.dataType)
        for f in columns
    }
    fault = F.when(F.col(LINE).isNotNull(), "fields")
    for name, made in value.items():
        fault = fault.when(F.col(name).isNotNull() & made.isNull(), name)
    judged = raw.withColumn(FAULT, fault)
    rows = judged.where(F.col(FAULT).isNull()).select(*[made.alias(name) for name, made in value.items()])
    written = F.to_csv(F.struct(*value), {"nullValue": ""})
    rejected = judged.where(F.col(FAULT).isNotNull()).select(F.coalesce(LINE, written).alias("text"), F.col(FAULT).alias("reason"))
    return rows, rejected


def quarantine(rejected: DataFrame, path: str) -> None:
    """Appends rejected lines to the table at `path`, by reason."""
    rejected.write.mode("append").partitionBy("reason").parquet(path)


def write_observations_csv(df: DataFrame, path: str) -> None:
    df.withColumn("date_time", F.col("date_time").cast("string")).write.mode("overwrite").option(
        "header", True
    ).csv(path)


def read_observation_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_observation_table(df: DataFrame, path: str) -> None:
    """The cleaned table by year, so year filters prune whole folders."""
    df.withColumn("obs_year", F.year("date_time")).write.mode("overwrite").partitionBy("obs_year").parquet(path)
