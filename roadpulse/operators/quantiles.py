"""Exact quantiles of any number of rows by selection on order-keeping bits.

Equal values of a group are counted first, in one pass over the rows; all that follows reads these counts. A number
becomes a long with the same order (a double by its bits). One pass adds up the counts of each group per leading bits, the running counts name the bits that hold each wanted rank, and the next pass adds up only the values that have
them, per further bits, until the bits are whole. Bits that only one value has are whole at once, so numbers with few
digits take one pass, and Spark leaves out the passes that nothing is left for. Counts are combined
before each shuffle; no task holds a group's values, and all groups and quantiles go through the same passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Low bits that are still open after each pass: of doubles, the first sees sign, exponent and 16 bits of the fraction.
OPEN_BITS = {True: (40, 20, 0), False: (36, 18, 0)}


def order_key(value: Column, whole: bool) -> Column:
    """A long with the order of `value`: the number itself, or a double's bits with those of negative ones turned round.
    Both zeros are one, NaN is above all."""
    if whole:
        return value.cast("long")
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + 0.0).cast("long")
    return bits.bitwiseXOR(F.shiftright(bits, 63).bitwiseAND(F.lit((1 << 63) - 1)))


def value_of_key(key: Column, whole: bool) -> Column:
    if whole:
        return key.cast("double")
    bits = key.bitwiseXOR(F.shiftright(key, 63).bitwiseAND(F.lit((1 << 63) - 1)))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], groups: Sequence[str] = (), into: str = "quantiles") -> DataFrame:
    """One row per group: the group's columns, and an array with the quantile of each share, between two neighbouring
    values in proportion. Nulls don't count; a group without values has no row, but the whole table as one group has one,
    with nulls. The ranks looked for are broadcast between passes: two for each share and group, so groups are to be few."""
    whole = isinstance(df.schema[column].dataType, T.LongType)
    g = F.struct(*[F.col(c).alias(c) for c in groups]) if groups else F.struct(F.lit(0).alias("all"))
    # a struct compares null fields as equal, so rows without a value for a group form one of their own
    counts = df.where(F.col(column).isNotNull()).groupBy(g.alias("_g"), F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    keyed = counts.select("_g", order_key(F.col("_v"), whole).alias("_k"), "_c")
    shares = list(shares)

    def ranked(counted: DataFrame, by: list[str], wanted: Column | None) -> DataFrame:
        """The bits that hold each wanted rank, with the ranks counted from their first row, and the least and largest key."""
        order = Window.partitionBy(*by).orderBy("_x")
        upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = counted.withColumn("_upto", upto)
        if wanted is None:
            rows = rows.withColumn("_size", F.sum("_n").over(Window.partitionBy(*by)))
            ends = [f(F.lit(s) * (F.col("_size") - 1)).cast("long") for s in shares for f in (F.floor, F.ceil)]
            wanted = F.array(*[F.struct(F.lit(i).alias("i"), r.alias("r")) for i, r in enumerate(ends)])
        start = F.col("_upto") - F.col("_n")
        here = F.filter(wanted, lambda w: (w["r"] >= start) & (w["r"] < F.col("_upto")))
        kept = F.transform(here, lambda w: F.struct(w["i"].alias("i"), (w["r"] - start).alias("r")))
        return rows.withColumn("_w", kept).where(F.size("_w") > 0).select("_g", "_low", "_high", "_w", "_size")

    sums = (F.sum("_c").alias("_n"), F.min("_k").alias("_low"), F.max("_k").alias("_high"))
    shifts = OPEN_BITS[whole]
    picked = ranked(keyed.groupBy("_g", F.shiftright("_k", shifts[0]).alias("_x")).agg(*sums), ["_g"], None)
    done = picked.where("_low = _high")
    for before, shift in zip(shifts, shifts[1:]):
        left = picked.where("_low < _high").select(F.col("_g").alias("_pg"), F.shiftright("_low", before).alias("_b"), F.col("_w").alias("_v"), F.col("_size").alias("_s"))
        inside = keyed.join(F.broadcast(left), F.col("_g").eqNullSafe(F.col("_pg")) & F.shiftright("_k", before).eqNullSafe(F.col("_b")))
        counted = inside.groupBy("_g", "_b", F.shiftright("_k", shift).alias("_x")).agg(*sums, F.first("_v").alias("_v"), F.first("_s").alias("_size"))
        picked = ranked(counted, ["_g", "_b"], F.col("_v"))
        done = done.unionByName(picked.where("_low = _high"))
    ends = done.select("_g", "_size", F.explode("_w.i").alias("i"), value_of_key(F.col("_low"), whole).alias("v"))
    by_rank = F.map_from_entries(F.collect_list(F.struct("i", "v")))  # two entries for each share
    found = ends.groupBy(*(["_g"] if groups else [])).agg(by_rank.alias("_m"), F.max("_size").alias("_size"))

    def between(i: int, share: float) -> Column:
        low, high = F.try_element_at("_m", F.lit(2 * i)), F.try_element_at("_m", F.lit(2 * i + 1))
        place = F.lit(share) * (F.col("_size") - 1)
        return F.when((F.ceil(place) == F.floor(place)) | (low == high), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return found.select(*[F.col("_g")[c].alias(c) for c in groups], F.array(*[between(i, s) for i, s in enumerate(shares)]).alias(into))
