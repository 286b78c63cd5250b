"""Ordered windows over long series without sending a series to one task.

The rows are ordered by (series, time, tie) and cut into blocks at the quantiles of a seeded sample, the rows
whose hash is small enough. The number of blocks follows from the number of rows, so a block keeps its size as
the table grows, and a bound stands for PER_BLOCK sampled rows. Bounds are values of all three, so a hot series, span or instant
spreads over blocks. Windows run per block; the few rows a block needs from before its start arrive as a
short array per block. Bounds shape the tasks only: any bounds give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 18
MIN_BLOCKS = 64
PER_BLOCK = 32


def _series(keys: Sequence[str]) -> Column:
    # A struct compares null fields as equal, so rows without a key form a series of their own.
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def _place(keys: Sequence[str], ts: str, tie: str) -> Column:
    return F.struct(_series(keys).alias("s"), F.col(ts).alias("t"), F.col(tie).alias("i"))


def block_count(n_rows: int, block_rows: int = BLOCK_ROWS, least: int = MIN_BLOCKS) -> int:
    """As many blocks as hold about `block_rows` rows each, and `least` for the cores of a small table."""
    return max(least, -(-n_rows // block_rows))


def block_bounds(df: DataFrame, keys, ts: str, tie: str, blocks: int, n_rows: int) -> Column:
    """Ascending places that cut `df` into about `blocks` parts, as a scalar subquery. Of `n_rows` rows those are sampled
    whose hash lies in the lowest PER_BLOCK x `blocks` / `n_rows` of its range, whatever the number of
    map tasks; every PER_BLOCK-th of them is a bound."""
    place = _place(keys, ts, tie)
    share = min(1.0, blocks * PER_BLOCK / max(n_rows, 1))
    limit = min(int((share - 0.5) * 2.0**64), 2**63 - 1)
    sample = df.select(place.alias("p")).where(F.xxhash64("p") <= F.lit(limit))
    per_bound = max(1, round(share * n_rows / blocks))
    spread = F.filter(F.array_sort(F.collect_list("p")), lambda x, i: i % per_bound == per_bound - 1)
    return sample.agg(spread).scalar()


def with_blocks(
    df: DataFrame, keys=(), ts: str = "date_time", tie: str = "obs_id", blocks: int | None = None,
    bounds_from: DataFrame | None = None,
) -> DataFrame:
    """Adds `_series` and an order-keeping `_block`. `bounds_from` is any frame with about these rows that is
    cheaper to count and read, such as the table before cleaning."""
    like = df if bounds_from is None else bounds_from
    n_rows = like.count()
    blocks = blocks or block_count(n_rows)
    bounds = block_bounds(like, keys, ts, tie, blocks, n_rows)
    steps = [1 << k for k in range(blocks.bit_length() + 1, -1, -1)]  # a sample may give some bounds more
    # number of bounds at or before the row's place, by bisection
    found = F.aggregate(
        F.array(*[F.lit(k) for k in steps]), F.lit(0),
        lambda at, step: F.when(F.get(F.col("_bounds"), at + step - 1) <= F.col("_place"), at + step).otherwise(at),
    )
    return (
        df.withColumns({"_bounds": bounds, "_place": _place(keys, ts, tie)})
        .withColumns({"_series": _series(keys), "_block": found}).drop("_bounds", "_place")
    )


def block_carry(blocked: DataFrame, value: str, ts: str, tie: str, depth: int) -> DataFrame:
    """Per block, the last `depth` values of its series before the block, oldest first.

    Row-number-limited windows keep `depth` rows per map task before the shuffle, so this moves
    blocks x depth values. Short blocks reach back over up to `depth` earlier blocks.
    """
    newest_first = Window.partitionBy("_series", "_block").orderBy(F.desc("_t"), F.desc("_i"))
    tails = (
        blocked.select("_series", "_block", F.col(ts).alias("_t"), F.col(tie).alias("_i"), F.col(value).alias("_v"))
        .withColumn("_back", F.row_number().over(newest_first))
        .where(F.col("_back") <= depth)
        .groupBy("_series", "_block")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("o"), F.col("_v").alias("v")))).alias("_tail"))
        .select("_series", "_block", F.col("_tail.v").alias("_tail"))
    )
    earlier = Window.partitionBy("_series").orderBy("_block").rowsBetween(-depth, -1)
    joined = F.flatten(F.collect_list("_tail").over(earlier))
    start = F.greatest(F.size("_all") - depth + 1, F.lit(1))
    return tails.withColumn("_all", joined).select(
        "_series", "_block", F.slice("_all", start, F.lit(depth)).alias("_carry")
    )


def median_value(df: DataFrame, column: str) -> DataFrame:
    """Exact median as one row. Equal values are counted first (distributed), then one weighted
    percentile runs over the distinct values."""
    counted = df.groupBy(F.col(column).alias("_v")).count()
    return counted.agg(F.percentile("_v", 0.5, F.col("count")).alias("median"))


def lag_features(
    df: DataFrame, volume: str = "traffic_volume", keys=(), ts: str = "date_time", tie: str = "obs_id",
    lags=(1, 24), means=(3, 6), fill: float | None = None, **blocks,
) -> DataFrame:
    """Row-offset lags and trailing means (current row excluded, short history allowed).

    Gaps are filled with the median of the whole table, or with `fill` (for instance the median of
    a training part). `tie` must order rows of equal time.
    """
    depth = max(*lags, *means)
    if fill is None:
        fill_value = df.transform(median_value, volume).scalar()
    else:
        fill_value = F.lit(float(fill))
    blocked = with_blocks(df, keys, ts, tie, **blocks)
    order = Window.partitionBy("_series", "_block").orderBy(ts, tie)
    v = F.col(volume).cast("double")

    # Everything inside the block: one shuffle, one sort.
    inside = {"_rn": F.row_number().over(order)}
    for k in lags:
        inside[f"_lag{k}"] = F.lag(v, k).over(order)
    for n in means:
        frame = order.rowsBetween(-n, -1)
        inside[f"_sum{n}"] = F.sum(v).over(frame)
        inside[f"_cnt{n}"] = F.count(v).over(frame)

    rn, carry = F.col("_rn"), F.col("_carry")
    out = {}
    for k in lags:
        before = F.try_element_at(carry, (rn - k - 1).cast("int"))
        out[f"traffic_lag_{k}h"] = F.coalesce(F.when(rn > k, F.col(f"_lag{k}")).otherwise(before), "_fill")
    for n in means:
        missing = F.lit(n) - rn + 1
        start = F.greatest(F.size(carry) - missing + 1, F.lit(1))
        older = F.filter(F.slice(carry, start, missing), lambda x: x.isNotNull())
        s = F.coalesce(f"_sum{n}", F.lit(0.0))
        c = F.col(f"_cnt{n}")
        s_all = F.aggregate(older, s, lambda a, x: a + x)
        use_carry = (rn <= n) & (F.size(carry) > 0)
        total = F.when(use_carry, s_all).otherwise(s)
        count = F.when(use_carry, c + F.size(older)).otherwise(c)
        out[f"traffic_rolling_{n}h"] = F.coalesce(F.when(count > 0, total / count), "_fill")

    carried = block_carry(blocked.withColumn("_cv", v), "_cv", ts, tie, depth)
    return (
        blocked.withColumns(inside)
        .join(carried, ["_series", "_block"], "left")  # co-partitioned with the windows
        .withColumn("_carry", F.coalesce("_carry", F.array().cast("array<double>")))
        .withColumn("_fill", fill_value)
        .withColumns(out)
        .drop("_series", "_block", "_carry", "_fill", *inside)
    )
