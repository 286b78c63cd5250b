"""Splits, class weights, confusion matrices and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.functions import columns as C
from roadpulse.operators.ranking import seeded_hash, seeded_sample

N_CLASSES = len(V.CONGESTION_LABELS)
BLOCK_ROWS = 512
RANKED = 4096


# --- stratified split -------------------------------------------------------------------

def split_cuts(df: DataFrame, share: float, seed: int, label: str, key: str) -> DataFrame:
    """Per class, the last (hash, key) that still belongs to the test part: one row per class.

    The exact rank is found without ordering a class in one task: rows are counted per hash prefix,
    running totals name the prefix that holds the cut, and only that prefix is ranked.
    """
    hashed = df.select(F.col(label).alias("_label"), F.col(key).alias("_key"), seeded_hash(seed, key).alias("_hash"))
    hashed = hashed.withColumn("_prefix", F.substring("_hash", 1, 4))
    counts = hashed.groupBy("_label", "_prefix").agg(F.count(F.lit(1)).alias("n"))
    per_class = Window.partitionBy("_label")  # at most 65,536 prefixes each
    counts = (
        counts.withColumn("_want", F.ceil(F.sum("n").over(per_class) * share))
        .withColumn("_upto", F.sum("n").over(per_class.orderBy("_prefix")))
        .where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("n") < F.col("_want")))
        .select("_label", "_prefix", (F.col("_want") - F.col("_upto") + F.col("n")).alias("_rank"))
    )
    edge = hashed.join(F.broadcast(counts), ["_label", "_prefix"])  # one row per class
    rank = F.row_number().over(Window.partitionBy("_label", "_prefix").orderBy("_hash", "_key"))
    return edge.withColumn("_r", rank).where(F.col("_r") == F.col("_rank")).select(
        "_label", F.struct("_hash", "_key").alias("_cut")
    )


def stratified_split(
    df: DataFrame, share: float = 0.15, seed: int = 42, label: str = "congestion_code", key: str = "obs_id",
    population: DataFrame | None = None,
) -> DataFrame:
    """Adds `is_test`: exactly ceil(share x n) rows of every class, chosen by seeded hash order.
    The rows themselves are only compared with a one-row-per-class table; they are not shuffled.
    `population`, if given, has the same (key, label) rows and is cheaper to read than `df`."""
    cuts = split_cuts(df if population is None else population, share, seed, label, key)
    here = F.struct(seeded_hash(seed, key).alias("_hash"), F.col(key).alias("_key"))
    return (
        df.join(F.broadcast(cuts), F.col(label) == F.col("_label"), "left")
        .withColumn("is_test", C.flag(F.coalesce(here <= F.col("_cut"), F.lit(False))))
        .drop("_label", "_cut")
    )


def class_weights(df: DataFrame, label: str = "congestion_code") -> DataFrame:
    """n / (k x n_class), one row per class present."""
    every = Window.partitionBy(F.lit(0))  # one row per class
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn(
        "weight", F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    )


def with_class_weights(df: DataFrame, label: str = "congestion_code", column: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(label, F.col("weight").alias(column))
    return df.join(F.broadcast(w), label, "left")  # one row per class


# --- metrics ----------------------------------------------------------------------------

def accuracy(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return pred.agg(F.round(F.avg(C.flag(F.col(actual) == F.col(predicted))), 4).alias("accuracy"))


def confusion_matrix(pred: DataFrame, *by: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Long form, zero-filled, one row per (group, actual, predicted). One conditional aggregation."""
    a, p = F.col(actual), F.col(predicted)
    cells = [
        F.struct(F.lit(i).alias("actual"), F.lit(j).alias("predicted"), F.count_if((a == i) & (p == j)).alias("n"))
        for i in range(N_CLASSES) for j in range(N_CLASSES)
    ]
    return pred.groupBy(*by).agg(F.array(*cells).alias("c")).select(*by, F.inline("c"))


def _ratio(x: Column, y: Column) -> Column:
    return F.when(y > 0, x / y).otherwise(F.lit(0.0))


def _report_rows() -> list[Column]:
    """Aggregates over confusion cells: one struct per class."""
    n, a, p = F.col("n"), F.col("actual"), F.col("predicted")
    rows = []
    for i, name in enumerate(V.CONGESTION_LABELS):
        hit = F.sum(F.when((a == i) & (p == i), n).otherwise(0))
        support = F.sum(F.when(a == i, n).otherwise(0))
        claimed = F.sum(F.when(p == i, n).otherwise(0))
        pr, rc = _ratio(hit, claimed), _ratio(hit, support)
        rows.append(F.struct(
            F.lit(i).alias("code"), F.lit(name).alias("class"), pr.alias("precision"), rc.alias("recall"),
            _ratio(2 * pr * rc, pr + rc).alias("f1"), support.alias("support"),
        ))
    return rows


def class_report(confusion: DataFrame, *by: str) -> DataFrame:
    """Precision, recall, F1 and support per class from the marginals; zero on zero division."""
    return confusion.groupBy(*by).agg(F.array(*_report_rows()).alias("c")).select(*by, F.inline("c"))


def report_averages(report: DataFrame, *by: str) -> DataFrame:
    """Macro and support-weighted averages of a class report."""
    rows = []
    for name, avg in (
        ("macro avg", lambda c: F.avg(c)),
        ("weighted avg", lambda c: _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))),
    ):
        rows.append(F.struct(
            F.lit(name).alias("class"), avg("precision").alias("precision"), avg("recall").alias("recall"),
            avg("f1").alias("f1"), F.sum("support").alias("support"),
        ))
    return report.groupBy(*by).agg(F.array(*rows).alias("c")).select(*by, F.inline("c"))


def weighted_f1(report: DataFrame, *by: str) -> DataFrame:
    return report_averages(report, *by).where(F.col("class") == "weighted avg").select(
        *by, F.col("f1").alias("f1_weighted")
    )


def _summary_columns(confusion: DataFrame, *by: str) -> DataFrame:
    """One row per group: accuracy, weighted F1 and the class report as an array, in one aggregation."""
    n, diagonal = F.col("n"), F.col("actual") == F.col("predicted")
    total = lambda f: F.aggregate(F.transform("_c", f), F.lit(0.0), lambda a, x: a + x)
    grouped = confusion.groupBy(*by).agg(
        (F.sum(F.when(diagonal, n).otherwise(0)) / F.sum("n")).alias("accuracy"), F.array(*_report_rows()).alias("_c")
    )
    return grouped.withColumn(
        "f1_weighted", _ratio(total(lambda c: c["f1"] * c["support"]), total(lambda c: c["support"].cast("double")))
    )


def summary_from_confusion(confusion: DataFrame, *by: str) -> DataFrame:
    """Accuracy and weighted F1 per group, rounded to four decimals."""
    return _summary_columns(confusion, *by).select(
        *by, F.round("accuracy", 4).alias("accuracy"), F.round("f1_weighted", 4).alias("f1_weighted")
    )


def summary_metrics(pred: DataFrame, *by: str) -> DataFrame:
    return summary_from_confusion(confusion_matrix(pred, *by), *by)


# --- model tables -----------------------------------------------------------------------

def leaderboard(metrics: DataFrame) -> DataFrame:
    """Models by weighted F1, the first name on ties; a handful of rows."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("f1_weighted"), "model")
    return metrics.withColumn("position", F.row_number().over(order)).withColumn(
        "is_best", C.flag(F.col("position") == 1)
    )


def best_model(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("f1_weighted"), "model").limit(1).select(
        F.col("model").alias("best_model"), F.round("f1_weighted", 4).alias("f1_weighted"),
        F.lit(len(V.FEATURES)).alias("feature_count"),
    )


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k).select("feature", "importance")


def per_class_long(report: DataFrame) -> DataFrame:
    """(model, class, metric, value) from per-class reports."""
    return report.select(
        "model", "class", *[F.col(c).cast("double").alias(c) for c in ("precision", "recall", "f1", "support")]
    ).unpivot(["model", "class"], ["precision", "recall", "f1", "support"], "metric", "value")


def six_axes(confusion: DataFrame) -> DataFrame:
    """Accuracy, weighted F1 and the F1 of each class, one row per model."""
    return _summary_columns(confusion, "model").select(
        "model", F.round("accuracy", 4).alias("accuracy"), F.round("f1_weighted", 4).alias("weighted_f1"),
        *[F.col("_c")[i]["f1"].alias(f"{n.lower()}_f1") for i, n in enumerate(V.CONGESTION_LABELS)],
    )


# --- permutation importance -------------------------------------------------------------

def hash_number(hashed: Column) -> Column:
    """The first eight hexadecimal digits as a number."""
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long")


def permutation_importance(
    test: DataFrame, scorer, features=V.FEATURES, rows: int | None = None, repeats: int = 5, seed: int = 42,
    label: str = "congestion_code", key: str = "obs_id", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Weighted-F1 drop per feature moved within blocks of rows: mean and population deviation over the repeats. A cheaper stand-in
    for `shuffled_importance`, which moves values over the whole table and is what the queries and the training job use.

    Takes all test rows, or a seeded sample of `rows` where asked for. A seeded hash deals them into blocks of about `block_rows`
    rows and orders each block, so places are random. The donor of a place is computed: it lies a number of
    places further round the block, a number drawn for every (feature, repeat, block). That moves each value to one other
    row, and the rows are shuffled once, whatever the number of features and repeats; their copies are made, scored and
    counted where the block lies. `key` tells the rows apart: rows with one key share a block. Without rows there is no importance.
    """
    sample = test.select(key, label, *features)
    if rows is not None:
        sample = seeded_sample(sample, rows, seed, key)
    blocks = max(1, sample.count() // block_rows)
    own = seeded_hash(f"{seed}-receiver", key)
    row = F.struct(own.alias("h"), F.col(key).alias("k"), F.col(label).alias("y"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    dealt = sample.groupBy((hash_number(own) % blocks).alias("_block")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    trials = F.array(
        F.struct(F.lit("").alias("feature"), F.lit(-1).alias("repeat"), F.lit(-1).alias("at")),
        *[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat"), F.lit(i).alias("at")) for i, f in enumerate(features) for r in range(repeats)],
    )
    size = F.size("_rows")
    drawn = hash_number(seeded_hash(f"{seed}-shift", "feature", "repeat", "_block"))
    swapped = (
        dealt.select("_block", "_rows", F.inline(trials))
        .withColumn("_shift", (drawn % F.greatest(size - 1, F.lit(1)) + 1).cast("int"))
        .select("feature", "repeat", "at", F.inline(F.transform("_rows", lambda x, i: F.struct(
            x["k"].alias(key), x["y"].alias(label), x["x"].alias("_x"),
            F.get(F.get(F.col("_rows"), F.pmod(i + F.col("_shift"), size))["x"], F.col("at")).alias("_donor"),
        ))))
    )
    copies = swapped.select(key, label, "feature", "repeat", *[
        F.when(F.col("at") == i, F.col("_donor")).otherwise(F.col("_x")[i]).alias(f) for i, f in enumerate(features)
    ])
    return _drops(scorer(copies), label)


def numbered(df: DataFrame, groups: Sequence[str], hashed: Column, then: Sequence[str], into: str, rows: int) -> DataFrame:
    """Numbers the rows of each group, of about `rows` each, from 1 in the order of (hash, `then`): counts per hash prefix give each
    prefix its first number, so a group is ranked in parts of about RANKED rows."""
    digits = next((i for i in range(1, 8) if rows <= RANKED * 16**i), 8)
    df = df.withColumn("_text", hashed).withColumns({"_prefix": F.substring("_text", 1, digits), "_hash": F.unhex("_text")}).drop("_text")
    by = [*groups, "_prefix"]
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(c).alias(f"_s_{c}") for c in by], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_hash", *then)))
    met = [F.col(c) == F.col(f"_s_{c}") for c in by]
    return ranked.join(starts, met).withColumn(into, F.col("_start") + F.col("_rank")).drop(
        "_hash", "_prefix", "_rank", "_start", *[f"_s_{c}" for c in by]
    )


def shuffled_importance(
    test: DataFrame, scorer, features=V.FEATURES, rows: int | None = None, repeats: int = 5, seed: int = 42,
    label: str = "congestion_code", key: str = "obs_id",
) -> DataFrame:
    """Weighted-F1 drop per shuffled feature: mean and population deviation over the repeats.

    Takes all test rows, or a seeded sample of `rows` where asked for. They are numbered in seeded hash order once for the
    receivers and, per (feature, repeat), for the donors, so a value may move to any row of the table. One equi-join gives every
    row its donor value and one scoring pass covers all features and repeats. Donors travel as numbers, without names.
    """
    sample = test.select(key, label, *[F.col(f).cast("double").alias(f) for f in features])
    if rows is not None:
        sample = seeded_sample(sample, rows, seed, key)
    n = sample.count()
    own = numbered(sample, (), seeded_hash(f"{seed}-receiver", key), (key, label, *features), "_pos", n)
    values = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(f).alias("feature"), F.col(f).alias("value")) for i, f in enumerate(features)])
    long = sample.select(key, F.inline(values)).withColumn("repeat", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))
    long = long.withColumn("_hashed", seeded_hash(seed, "feature", "repeat", key)).drop("feature")
    donors = numbered(long, ("at", "repeat"), F.col("_hashed"), (key, "value"), "_pos", n).select("at", "repeat", "value", "_pos")
    swapped = own.join(donors, "_pos").withColumns({f: F.when(F.col("at") == i, F.col("value")).otherwise(F.col(f)) for i, f in enumerate(features)})
    base = sample.withColumns({"at": F.lit(-1), "repeat": F.lit(-1)})
    both = swapped.select(key, label, *features, "at", "repeat").unionByName(base)
    names = F.array(*[F.lit(f) for f in ("", *features)])
    return _drops(scorer(both).withColumn("feature", F.get(names, F.col("at") + 1)), label)


def _drops(scored: DataFrame, label: str) -> DataFrame:
    """Drop of the weighted F1 below that of the rows of feature '', per feature over its repeats."""
    conf = confusion_matrix(scored, "feature", "repeat", actual=label, predicted="pred_code")
    f1 = weighted_f1(class_report(conf, "feature", "repeat"), "feature", "repeat")
    every = Window.partitionBy(F.lit(0))  # one row per (feature, repeat)
    base = F.max(F.when(F.col("feature") == "", F.col("f1_weighted"))).over(every)
    return (
        f1.withColumn("_drop", base - F.col("f1_weighted")).where(F.col("feature") != "")
        .groupBy("feature").agg(F.avg("_drop").alias("importance"), F.stddev_pop("_drop").alias("std"))
    )
