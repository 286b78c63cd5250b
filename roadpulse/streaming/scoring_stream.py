"""Continuous scoring of arriving condition rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadpulse.operators.corridor import SALTS, base_predictions, corridor_state
from roadpulse.operators.scoring import Scorer
from roadpulse.schema import CONDITIONS


def read_condition_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Condition rows from a folder of Parquet files as they arrive."""
    r = spark.readStream.schema(CONDITIONS)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def corridor_alerts(conditions: DataFrame, segments: DataFrame, scorer: Scorer, level: str = "High", salts: int = SALTS) -> DataFrame:
    """Conditions to alerted segments. Stateless: the last volume arrives in the row, so the same
    plan serves a batch and a stream joined with the static segment table. Only alerted segments enter the join. Where batches
    are bounded in rows, one salt will do: the segments are then not copied for each."""
    return corridor_state(base_predictions(conditions, scorer), segments, salts, level)


def run_alert_stream(
    conditions: DataFrame, segments: DataFrame, scorer: Scorer, out: str, checkpoint: str,
    level: str = "High", available_now: bool = True, salts: int = SALTS,
):
    """Append alerts to a Parquet folder; the file sink and the checkpoint give exactly-once output."""
    writer = (
        corridor_alerts(conditions, segments, scorer, level, salts)
        .writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
