"""Small helpers for reading inputs and running Arrow functions inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from roadpulse.session import scratch_path, shared_dir

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df` with its rows in the shared checkpoint folder, so later jobs neither recompute nor lose them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a compressed table in the shared folder; for tables too large for a checkpoint's plain rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that deals both sides out by key; a broadcast would gather it on the driver first."""
    return df.hint("merge")


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of `batch` of about `most` bytes each; a longer row is a part of its own."""
    rows = max(1, batch.num_rows)
    size = np.zeros(rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            bounds = column.cast(pa.large_string())
            at = np.frombuffer(bounds.buffers()[1], np.int64)[bounds.offset: bounds.offset + batch.num_rows + 1]
            size[: batch.num_rows] += np.diff(at)
    part = np.cumsum(size) // most
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Applies `function` to parts of each record batch; it returns the output columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(function(part))

    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of `df`, repeats included, for which `keep` (a part of a record batch -> booleans) is true; no key is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(np.asarray(keep(part), bool)))

    return df.mapInArrow(run, df.schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    column = batch.column(name)
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and where each row starts (and the last one ends)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]: bounds[-1]], bounds - bounds[0]


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of maximal runs of non-white bytes in each row."""
    raw, bounds = flat(column)
    if not len(raw):
        return np.zeros(len(column), np.int64)
    solid = ~WHITE[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = bounds[:-1][bounds[:-1] < len(raw)]
    begins[inner] = solid[inner]
    total = np.concatenate([[0], np.cumsum(begins)])
    return total[bounds[1:]] - total[bounds[:-1]]
