"""Mixes sources to target weights by weighted fair queueing.

Each document's place in its source's shuffled queue is fixed by a hash of doc_id. A source's queue is read as
often as its target asks for; the document read when `c` words of its source have been read gets the virtual
finish time c / target. Ordering all readings by finish time and stopping at the total budget serves every
source in proportion to its target at any moment. Readings that are under way at that
moment are cut.

Running totals come in two steps, so that no source and no time span is ordered in one task: per bucket of the
queue (sums, combined before the shuffle), then inside a bucket; and over the range partitions of the global
sort, whose sums alone reach the driver.

Null texts have size 0, and like other documents of size 0 they take nothing. A null source is a source, the
last one. Repeated rows are separate documents. Ties in the queue go by doc_id. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.frames import arrow_map, cut, word_counts

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BUCKETS = 1 << 11
FIRST = -(2**63)


def sizes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, source and the number of words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    count = lambda b: {"doc_id": b.column("doc_id"), "source": b.column("source"), "size": word_counts(b.column("text"))}
    return arrow_map(docs.select("doc_id", "source", "text"), count, f"doc_id {kind}, source string, size long")


def targets(totals: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = REPEATS) -> list[tuple]:
    """(source, its size, its target): `share` of all words by weight, none above `most` times its size.

    Weights repeat over the sources in code-point order, null last. What a capped source can't take is shared
    again by weight among the others until none is above its cap.
    """
    order = sorted(totals, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    target = [0.0] * len(order)
    free, left = set(range(len(order))), share * sum(n for _, n in order)
    while free:
        whole = sum(weight[i] for i in free)
        over = {i for i in free if left * weight[i] / whole > most * order[i][1]}
        for i in over or free:
            target[i] = float(most * order[i][1]) if over else left * weight[i] / whole
        if not over:
            break
        left -= sum(target[i] for i in over)
        free -= over
    return [(s, n, t) for (s, n), t in zip(order, target)]


def queue(sized: DataFrame) -> DataFrame:
    """Adds `bucket` and `nth` (a row's own place) and `before` (words of its source read earlier)."""
    key = F.xxhash64("doc_id")
    bucketed = sized.withColumn("_key", key).withColumn("bucket", F.pmod(F.shiftrightunsigned(key, 40), F.lit(BUCKETS)))
    source = [F.col("source").isNull().alias("_no_source"), "source"]
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("_sum"))
    over = Window.partitionBy(*source).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(over), F.lit(0)))
    starts = starts.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "_start")
    inside = Window.partitionBy("source", "bucket").orderBy("_key", "doc_id", "size")
    placed = bucketed.withColumn("nth", F.row_number().over(inside)).withColumn(
        "_inside", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    both = placed.join(starts, placed["source"].eqNullSafe(starts["_source"]) & (placed["bucket"] == starts["_bucket"]))
    return both.withColumn("before", F.col("_start") + F.col("_inside")).select("doc_id", "source", "size", "bucket", "nth", "before")


def readings(sized: DataFrame, goals: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Each document once for each time that its source may be read, with its virtual finish time.

    `goals`: source, source_size, target.
    """
    wanted = goals.withColumnRenamed("source", "_goal")
    queued = queue(sized)
    # A source's queue is read again only while its target isn't reached.
    return (
        queued.join(wanted, queued["source"].eqNullSafe(wanted["_goal"])).drop("_goal")
        .withColumn("again", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn("finish", (F.col("before") + F.col("size") + F.col("again") * F.col("source_size")) / F.col("target"))
    )


def stop_time(goals: list[tuple], budget: float, repeats: int = REPEATS) -> float:
    """The virtual time at which the sources together have been served `budget` words."""
    left, served, done = budget, 0.0, 0.0
    for end, target in sorted((repeats * n / t, t) for _, n, t in goals if t > 0):
        rate = sum(t for _, n, t in goals if t > 0 and repeats * n / t > done)
        if served + rate * (end - done) >= left:
            return done + (left - served) / rate
        served, done = served + rate * (end - done), end
    return done


def truncated(read: DataFrame, goals: list[tuple], budget: float, repeats: int = REPEATS) -> DataFrame:
    """The mix in its order: `read` sorted by finish time, with `position` and `taken`, stopped at `budget` words.

    Readings that are through when the sources together have been served the budget are whole, those under way
    are cut to what their source is due at that time, and the running total over the order ends at the budget.
    """
    keys = ("finish", "doc_id", "again", "source", "bucket", "nth")
    begun = F.col("before") + F.col("again") * F.col("source_size")
    due = F.round(F.lit(stop_time(goals, budget, repeats)) * F.col("target"))
    served = read.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("size"), due - begun)).cast("long")).where("taken > 0")
    n = int(read.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(served.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    sums = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.sum("taken").alias("n")).collect()}  # one number a partition
    start, total, whole = {}, 0, int(round(budget))
    for part in sorted(sums):
        start[part], total = total, total + sums[part]

    def place(batches):
        done = None
        for batch in batches:
            if batch.num_rows:
                done = start[batch.column("_part")[0].as_py()] if done is None else done
                taken = np.asarray(batch.column("taken"))
                position = done + np.cumsum(taken) - taken
                done = int(position[-1] + taken[-1])
                kept = pa.array(np.clip(whole - position, 0, taken))
                yield pa.RecordBatch.from_arrays(
                    [kept if name == "taken" else batch.column(name) for name in names] + [pa.array(position)], [*names, "position"]
                )

    names = ranged.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + ", position long"
    return ranged.mapInArrow(place, schema).drop("_part")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted)."""
    spark = docs.sparkSession
    sized = cut(sizes(docs))
    totals = [(r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]  # one number a source
    goals = targets(totals, weights, share, repeats)
    frame = spark.createDataFrame(goals, "source string, source_size long, target double")
    read = readings(sized, frame, repeats)
    parts = truncated(read, goals, sum(t for _, _, t in goals), repeats)
    own = ("source", "bucket", "nth")
    taken = parts.groupBy(*own).agg(F.sum("taken").alias("_taken"))
    took = taken.select(*[F.col(c).alias(f"_{c}") for c in own], "_taken")
    all_ = read.where("again = 0")
    met = all_["source"].eqNullSafe(took["_source"]) & (all_["bucket"] == took["_bucket"]) & (all_["nth"] == took["_nth"])
    return all_.join(took, met, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken")
    )
