"""True lags of arriving observations: each series keeps its last readings as state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read_observation_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Observations from a folder of Parquet files as they arrive."""
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(path)


def history_columns(values: np.ndarray, lags: Sequence[int], means: Sequence[int]) -> dict[str, np.ndarray]:
    """Lags and trailing means of a series in order; NaN stands for a missing reading and for no history."""
    n = len(values)
    back = {k: np.concatenate([np.full(min(k, n), np.nan), values[: max(n - k, 0)]]) for k in {*lags, *range(1, max(means, default=0) + 1)}}
    out = {f"traffic_lag_{k}h": back[k] for k in lags}
    for m in means:
        total, count = np.zeros(n), np.zeros(n)
        for k in range(m, 0, -1):  # oldest first
            there = ~np.isnan(back[k])
            total[there] += back[k][there]
            count += there
        out[f"traffic_rolling_{m}h"] = np.divide(total, count, out=np.full(n, np.nan), where=count > 0)
    return out


def stream_lags(
    observations: DataFrame, keys: Sequence[str] = ("sensor_id",), volume: str = "traffic_volume", ts: str = "date_time",
    tie: str = "obs_id", lags: Sequence[int] = (1, 24), means: Sequence[int] = (3, 6), fill: float | None = None,
) -> DataFrame:
    """(keys, tie, ts, volume, lags, trailing means, late) of each arriving row, as `series.lag_features` gives them.

    A series keeps its last max(lags, means) readings by (ts, tie); that is all that the state holds.

    * Rows of one micro-batch may come in any order: they are sorted per series before they are judged. A micro-batch is what one
      task may have to sort of one series, so `files_per_batch` of the reader bounds it.
    * A row that is already among the kept readings, or comes twice in a micro-batch, is a repeat and gives no row. Of
      rows that differ in the volume only, the smallest volume stays.
    * A row before the newest kept reading is `late`: its history is what is kept before it, and later rows count it at
      its place. Rows already written are not revised. A row older than all readings of a full state has no known
      history and is not kept (nor known as a repeat).
    * Rows without time or tie have no place in a series and are left out; rows without key form a series.
    * Missing history, and a lag that meets a missing volume, give `fill`, or null where it is not given.
    """
    depth = max(*lags, *means)
    names = [f"traffic_lag_{k}h" for k in lags] + [f"traffic_rolling_{m}h" for m in means]
    kinds = {c: observations.schema[c].dataType.simpleString() for c in (*keys, tie, ts)}
    out_schema = ", ".join([*[f"{c} {kinds[c]}" for c in (*keys, tie, ts)], f"{volume} double", *[f"{c} double" for c in names], "late boolean"])
    rows = observations.where(F.col(ts).isNotNull() & F.col(tie).isNotNull()).select(*keys, tie, ts, F.col(volume).cast("double").alias(volume))

    def arrive(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ties, values = state.get if state.exists else ([], [], [])
        new = pd.concat(list(parts), ignore_index=True)
        new["_t"] = new[ts].to_numpy("datetime64[us]").astype(np.int64)
        new = new.sort_values(["_t", tie, volume]).drop_duplicates(["_t", tie])
        place = pd.Series(list(zip(new["_t"].tolist(), new[tie].tolist())), index=new.index, dtype=object)
        known = list(zip(times, ties))
        new, place = new[~place.isin(known)], place[~place.isin(known)]
        if new.empty:
            return
        late = place.map(lambda p: bool(known) and p < known[-1]).astype(bool)
        forgotten = place.map(lambda p: len(known) == depth and p < known[0]).astype(bool)
        kept = pd.DataFrame({"_t": np.array(times, np.int64), tie: pd.Series(ties, dtype=new[tie].dtype), volume: np.array(values, np.float64)})
        told = pd.concat([kept, new[~forgotten].assign(late=late[~forgotten])], ignore_index=True).sort_values(["_t", tie])
        told = told.assign(**history_columns(told[volume].to_numpy(np.float64), lags, means))
        last = told.tail(depth)
        state.update((last["_t"].tolist(), last[tie].tolist(), [None if np.isnan(v) else v for v in last[volume].tolist()]))
        out = pd.concat([told[told["late"].notna()], new[forgotten].assign(late=True, **dict.fromkeys(names, np.nan))])
        for name, value in zip(keys, key):
            out[name] = pd.Series([None if pd.isna(value) else value] * len(out), index=out.index, dtype=object)
        out["late"] = out["late"].astype(bool)
        yield out[[*keys, tie, ts, volume, *names, "late"]]

    told = rows.groupBy(*keys).applyInPandasWithState(
        arrive, out_schema, f"times array<long>, ties array<{kinds[tie]}>, volumes array<double>", "append", GroupStateTimeout.NoTimeout
    )
    return told if fill is None else told.withColumns({c: F.coalesce(c, F.lit(float(fill))) for c in names})


def run_lag_stream(observations: DataFrame, out: str, checkpoint: str, available_now: bool = True, **options):
    """Appends `stream_lags` to a Parquet folder. State and progress lie in `checkpoint`, so a new start goes on where
    the last one ended, and the file sink writes every row once."""
    writer = (
        stream_lags(observations, **options).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
