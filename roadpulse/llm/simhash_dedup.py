"""Near duplicates by SimHash, with all links found by meeting in the middle.

A text (ASCII letters lower-cased) is cut into words, runs of anything but blanks and control spaces, and into
shingles of `words` words, repeats included; bit i of its fingerprint is 1 if more than half of the shingles'
XXH64 values (seed 42) have it. Two fingerprints that differ in at most `radius` bits both lie within half the
radius of some third value. So every distinct fingerprint emits all values within half the radius, the values
are shuffled, and fingerprints that meet are linked after a check of their distance. A meeting place holds at
most as many fingerprints as it has values around it (65 for radius 2), whatever the data; there each is linked
to the smallest one that is near enough, and to the next smallest if not.

Texts with fewer words than a shingle are one shingle; null, empty and blank texts have fingerprint zero and
are linked like others. Repeated rows share a component; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.components import connected_components
from roadpulse.llm.frames import arrow_map, cut, stored, texts_of

WORDS = 3
RADIUS = 2


def text_fingerprint(text: bytes, words: int = WORDS) -> int:
    import xxhash

    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-1].tolist()]
    k = max(1, len(parts) - words + 1)
    hash_ = xxhash.xxh64_intdigest
    values = [hash_(joined[a:b], 42) for a, b in zip(starts[:k], (ends[len(parts) - k:] - 1).tolist())]
    bits = np.zeros(64, np.int64)
    for block in range(0, k, 1 << 16):
        part = np.array(values[block: block + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > k, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row: doc_id and the fingerprint as a (signed) long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def compute(batch: pa.RecordBatch) -> dict:
        found = np.array([text_fingerprint(t, words) for t in texts_of(batch)], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": found.view(np.int64)}

    return arrow_map(docs.select("doc_id", "text"), compute, f"doc_id {kind}, fp long")


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges between the distinct longs of `values` (fp) that connect whatever links within `radius` connect."""
    half = (radius + 1) // 2
    flips = [0]
    for n in range(1, half + 1):
        for at in combinations(range(64), n):
            mask = sum(1 << i for i in at)
            flips.append(mask - (1 << 64) if mask >> 63 else mask)
    # the whole fan-out stays in one generated expression: no row carries the list of flips
    spread = values.select("fp").distinct().select("fp", F.explode(F.array(*[F.lit(f) for f in flips])).alias("flip"))
    met = spread.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("place"))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius
    place = Window.partitionBy("place").orderBy("fp")
    if radius % 2 == 0:  # all that meet are within the radius of each other: a star has all links
        first = met.withColumn("first", F.first("fp").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return first.where("fp <> first").where(near("fp", "first")).select(F.col("first").alias("a"), F.col("fp").alias("b")).distinct()
    others = met.withColumn("before", F.collect_list("fp").over(place.rowsBetween(Window.unboundedPreceding, -1)))
    pairs = others.select(F.explode("before").alias("a"), F.col("fp").alias("b"))
    return pairs.where(near("a", "b")).distinct()


def components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, fp, component_id (the smallest doc_id that links lead to)."""
    marked = cut(fingerprints(docs, words))
    firsts = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(firsts, radius))
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_value = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(by_value, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of `docs` for each component: the smallest doc_id stays, then whatever a hash of the row puts first.

    Rows are told apart by doc_id and a hash of all columns, so rows without doc_id (last in the order) or with a
    repeated one are rows of their own; of rows equal in every column one stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*docs.columns).alias("row"))
    found = components(docs.select(key.alias("doc_id"), "text"), words, radius).where("doc_id = component_id")
    firsts = stored(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).select("doc_id.row", "doc_id.doc_id", "rows"), "firsts")

    def rows_of(some: DataFrame) -> DataFrame:
        own = some.select(F.col("row").alias("_row"), F.col("doc_id").alias("_id"))
        same = (F.xxhash64(*[docs[c] for c in docs.columns]) == F.col("_row")) & docs["doc_id"].eqNullSafe(F.col("_id"))
        return docs.join(own, same, "left_semi")

    kept, repeated = rows_of(firsts.where("rows = 1")), firsts.where("rows > 1")
    return kept if repeated.isEmpty() else kept.unionByName(rows_of(repeated).distinct())


def hexadecimal(fp):
    """16 lower-case digits of a long column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
