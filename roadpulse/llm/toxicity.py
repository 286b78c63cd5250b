"""Toxicity scores from class-conditional Kneser-Ney models.

The models predict the characters of a word from up to `order - 1` characters before it in the word. For an
n-gram hx (history h, character x) the toxic and the ordinary model use their own discounted counts,

    P_c(x | h) = max(n_c(hx) - D_c, 0) / n_c(h) + D_c * types_c(h) / n_c(h) * P(x | h'),

and share everything below: P(x | h') comes from continuation counts of both classes together (in how many
different left extensions a shorter n-gram occurs), backing off the same way down to single characters and
to a uniform distribution. A document's figure is the mean over its characters of log P_toxic - log P_ordinary,
and a logistic curve over it, fitted on labelled documents, gives the score.

Because the lower orders are shared they cancel for n-grams that neither class has: the ratio is then that of
the two backoff weights, or 1 for an unseen history. All n-grams of all labelled documents are counted; the
ratios then fit in a table of `slots` places (n-grams in one place are averaged by their counts), whose size
is a parameter.

Texts that are null, empty or without letters have figure 0. Documents without a label are scored, but teach
nothing; repeated labels of a document teach repeatedly. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.frames import arrow_map, cut, slices, stored
from roadpulse.llm.grams import GramSums, gram_keys, key_bits, mixed, passes

ORDER = 5
SLOTS = 1 << 22
ALPHABET = 256


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, toxic, ordinary): occurrences of each n-gram of the highest order by class."""

    def run(batches):
        held = GramSums(2)
        for batch in batches:
            for part in slices(batch):
                keys, rows = gram_keys(part.column("text"), order)
                toxic = np.asarray(part.column("toxic")).astype(bool)[rows]
                grams, place = np.unique(keys, return_inverse=True)
                t = np.bincount(place[toxic], minlength=len(grams))
                n = np.bincount(place, minlength=len(grams))
                if held.add(grams, np.stack([t, n - t], axis=1)):
                    yield rows_of(held)
                    held = GramSums(2)
        yield rows_of(held)

    def rows_of(held):
        grams, counts = held.sums()
        return pa.RecordBatch.from_pydict({"gram": grams.view(np.int64), "toxic": counts[:, 0], "ordinary": counts[:, 1]})

    part = labelled.where("text IS NOT NULL AND toxic IS NOT NULL").select("text", "toxic")
    counted = part.mapInArrow(run, "gram long, toxic long, ordinary long")
    return counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _history(gram):
    """The n-gram without its last character."""
    return F.shiftrightunsigned(gram, 8)


def _shorter(df: DataFrame) -> DataFrame:
    """(gram, n): how many n-grams each shorter one, without the first character, continues."""
    return df.where(F.col("gram") >= 256).groupBy(_suffix().alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def _suffix():
    """The n-gram without its first character."""
    return F.expr("gram & (shiftleft(1L, 8 * cast((length(hex(gram)) - 1) DIV 2 AS int)) - 1)")


def _discount(df: DataFrame, n: str) -> float:
    """Ney's estimate of the discount, n1 / (n1 + 2 n2); 0.5 where it can't be had."""
    row = df.agg(F.sum((F.col(n) == 1).cast("long")), F.sum((F.col(n) == 2).cast("long"))).first()
    once, twice = row[0] or 0, row[1] or 0
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once and twice else 0.5


def log_ratios(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(gram, ratio, weight) of n-grams seen in a class, and of histories for all that follows them unseen."""
    levels = [stored(counts, "grams")]
    for _ in range(order - 1):
        levels.append(stored(_shorter(levels[-1]), "grams"))
    same = Window.partitionBy(_history(F.col("gram")))  # at most one row a character
    shared = None
    for level in reversed(levels[1:]):
        d = _discount(level, "n")
        here = level.withColumn("all", F.sum("n").over(same)).withColumn("types", F.count(F.lit(1)).over(same))
        if shared is None:
            below = F.lit(1.0 / ALPHABET)
        else:
            lower = shared.withColumnRenamed("gram", "low").withColumnRenamed("p", "p_low")
            here = here.withColumn("low", _suffix()).join(lower, "low", "left")
            below = F.coalesce("p_low", F.lit(1.0 / ALPHABET))
        p = (F.col("n") - d) / F.col("all") + d * F.col("types") / F.col("all") * below
        shared = here.select("gram", p.alias("p"))
    top = levels[0].withColumn("h", _history(F.col("gram"))).withColumn("low", _suffix())
    for c in ("toxic", "ordinary"):
        top = top.withColumn(f"{c}_all", F.sum(c).over(same)).withColumn(f"{c}_types", F.sum((F.col(c) > 0).cast("long")).over(same))
    classes = ("toxic", "ordinary")
    discounts = {c: _discount(levels[0], c) for c in classes}
    weight = {c: F.when(F.col(f"{c}_all") > 0, discounts[c] * F.col(f"{c}_types") / F.col(f"{c}_all")).otherwise(1.0) for c in classes}
    if shared is not None:
        top = top.join(shared.withColumnRenamed("gram", "low"), "low", "left")
    else:
        top = top.withColumn("p", F.lit(None).cast("double"))
    own = {c: F.when(F.col(c) > 0, (F.col(c) - discounts[c]) / F.col(f"{c}_all")).otherwise(0.0) for c in classes}
    p = {c: own[c] + weight[c] * F.coalesce("p", F.lit(1.0 / ALPHABET)) for c in classes}
    seen = top.select(
        "gram", F.log(p["toxic"] / p["ordinary"]).alias("ratio"), (F.col("toxic") + F.col("ordinary")).alias("weight")
    )
    first = Window.partitionBy("h").orderBy("gram")
    histories = top.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    unseen = histories.select(
        F.col("h").alias("gram"), F.log(weight["toxic"] / weight["ordinary"]).alias("ratio"),
        (F.col("toxic_all") + F.col("ordinary_all")).alias("weight"),
    )
    return seen, unseen


def _slot_table(rows: DataFrame, slots: int, seed: int) -> np.ndarray:
    """Ratios by slot, NaN where no n-gram falls; at most `slots` rows reach the driver."""

    def place(batch: pa.RecordBatch) -> dict:
        keys = np.asarray(batch.column("gram")).view(np.uint64)
        return {"slot": _slots(keys, slots, seed), "ratio": batch.column("ratio"), "weight": batch.column("weight")}

    placed = arrow_map(rows, place, "slot long, ratio double, weight long").groupBy("slot").agg(
        (F.sum(F.col("ratio") * F.col("weight")) / F.sum("weight")).cast("float").alias("ratio")
    ).toArrow()
    out = np.full(slots, np.nan, np.float32)
    out[np.asarray(placed.column("slot"))] = np.asarray(placed.column("ratio"))
    return out


def _slots(keys: np.ndarray, slots: int, seed: int) -> np.ndarray:
    return (mixed(keys, seed) & np.uint64(slots - 1)).astype(np.int64)


def train(labelled: DataFrame, order: int = ORDER, slots: int = SLOTS) -> dict:
    """Both models from rows (text, toxic)."""
    seen, unseen = log_ratios(gram_counts(labelled, order), order)
    return {"order": order, "seen": _slot_table(seen, slots, 3), "unseen": _slot_table(unseen, slots, 4)}


def figures(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, the mean log ratio of its characters, and the largest share of it that one word has."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batch: pa.RecordBatch) -> dict:
        m = held.value
        keys, rows = gram_keys(batch.column("text").fill_null(""), m["order"])
        ratio = m["seen"][_slots(keys, len(m["seen"]), 3)]
        new = np.isnan(ratio)
        ratio[new] = np.nan_to_num(m["unseen"][_slots(keys[new] >> np.uint64(8), len(m["unseen"]), 4)])
        n = np.bincount(rows, minlength=batch.num_rows)
        total = np.bincount(rows, weights=ratio, minlength=batch.num_rows)
        return {"doc_id": batch.column("doc_id"), "log_ratio": total / np.maximum(n, 1), "n_grams": n}

    return arrow_map(docs.select("doc_id", "text"), score, f"doc_id {kind}, log_ratio double, n_grams long")


def calibrated(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds `score`: a logistic curve over the mean log ratio, fitted on the labelled rows (doc_id, toxic)."""
    spread = F.col("log_ratio") * F.sqrt(F.col("n_grams").cast("double"))
    wide = scored.withColumn("_evidence", spread)
    both = VectorAssembler(inputCols=["log_ratio", "_evidence"], outputCol="_features").transform(wide)
    learn = both.join(labels.select("doc_id", F.col("toxic").cast("double").alias("_label")), "doc_id").select("_features", "_label")
    seen = {r[0] for r in learn.select("_label").distinct().collect()}
    if len(seen) < 2:  # one class or no label: nothing to fit
        return scored.withColumn("score", F.lit(1.0 if seen == {1.0} else 0.0))
    fit = LogisticRegression(featuresCol="_features", labelCol="_label", probabilityCol="_p", predictionCol="_c",
                             rawPredictionCol="_r", regParam=1e-6, maxIter=100).fit(learn)
    return fit.transform(both).withColumn("score", vector_to_array("_p")[1]).drop("_p", "_c", "_r", "_features", "_evidence")


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(text, toxic) of the documents in `known`; a filter of fixed size spares most others the shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(key_bits(known.select(F.xxhash64("doc_id").alias("g"))))

    def sift(batches):
        for batch in batches:
            keep = passes(held.value, np.asarray(batch.column("g")).view(np.uint64))
            yield batch.filter(pa.array(keep)).select(["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    part = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("g")).mapInArrow(sift, f"doc_id {kind}, text string")
    return part.join(known, "doc_id").select("text", "toxic")


def score_toxicity(docs: DataFrame, labels: DataFrame, order: int = ORDER, slots: int = SLOTS) -> DataFrame:
    """Scores all `docs` (doc_id, text) after learning from those that `labels` (doc_id, toxic) marks.

    Four fifths of the labelled documents, by a hash of doc_id, give the counts; the rest, whose own n-grams
    the counts therefore don't hold, give the curve.
    """
    known = labels.where("toxic IS NOT NULL").select("doc_id", "toxic")
    curve = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    model = train(labelled(docs, known.where(~curve)), order, slots)
    return calibrated(cut(figures(docs, model)), known.where(curve))
