"""Whole jobs composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.operators.cleaning import clean, drop_exact_duplicates, drop_unlabelled, fill_holiday
from roadpulse.operators.evaluation import (
    class_report, report_averages, shuffled_importance, stratified_split,
)
from roadpulse.operators.features import (
    calendar_features, engineer, holiday_feature, label_congestion, row_features, rush_features,
)
from roadpulse.operators.learning import model_scorer, timed_fit, train_and_compare
from roadpulse.plans.manifest import Manifest
from roadpulse.session import release
from roadpulse.sources.artifacts import (
    read_importance, read_model, write_importance, write_metric_tables, write_metrics, write_model,
)


def prepared_history(raw: DataFrame, keys=(), tie: str | None = None, **series) -> DataFrame:
    """Raw observations to labelled feature rows: clean, engineer, label, drop unlabelled.

    Rows of equal time are ordered by `tie`, which is `obs_id` where there is one, else all columns together:
    after the exact duplicates are gone that is a total order.
    """
    if tie is None and "obs_id" in raw.columns:
        tie = "obs_id"
    whole_row = tie is None
    if whole_row:
        tie = "_tie"
        raw = raw.withColumn(tie, F.struct(*raw.columns))
    series.setdefault("bounds_from", raw)
    out = raw.transform(clean).transform(engineer, keys=keys, tie=tie, **series).transform(
        label_congestion
    ).transform(drop_unlabelled)
    return out.drop(tie) if whole_row else out


def labelled_rows(raw: DataFrame) -> DataFrame:
    """As `prepared_history` without the lag features, for questions that do not read them: one
    shuffle (the de-duplication) and the 24-row temperature lookup."""
    return raw.transform(clean).transform(row_features).transform(label_congestion).transform(drop_unlabelled)


def labelled_calendar(raw: DataFrame) -> DataFrame:
    """Calendar, rush and holiday columns with labels only; no temperature repair is needed."""
    return (
        raw.transform(drop_exact_duplicates).transform(fill_holiday)
        .transform(calendar_features).transform(rush_features).transform(holiday_feature)
        .transform(label_congestion).transform(drop_unlabelled)
    )


def training_rows(history: DataFrame, key: str = "obs_id") -> DataFrame:
    return history.select(key, "congestion_code", *V.FEATURES)


def read_split(spark: SparkSession, path: str) -> list[DataFrame]:
    table = spark.read.parquet(path)
    return [table.where(F.col("is_test") == i).drop("is_test") for i in (0, 1)]


def write_split(raw: DataFrame, path: str, keys=(), share: float = 0.15, seed: int = 42) -> list[DataFrame]:
    """Feature rows written once, by part, and read back as (train, test): the fits and the evaluation
    start from a table, and lost executors re-read files. The split ranks on calendar rows, so
    the lag features are computed in a single pass."""
    rows = training_rows(prepared_history(raw, keys=keys))
    rows = stratified_split(rows, share, seed, population=labelled_calendar(raw))
    rows.write.mode("overwrite").partitionBy("is_test").parquet(path)
    release(raw.sparkSession)
    return read_split(raw.sparkSession, path)


def train_job(
    raw: DataFrame, out: str, keys=(), settings: dict[str, dict] | None = None, models=None,
    share: float = 0.15, seed: int = 42, sample: int | None = None, repeats: int = 5, resume: bool = False,
):
    """Prepare, split, fit and compare, rank features, write artifacts. Returns (best name, summary, importance).

    The feature rows, every model and the importance are noted in `out`/finished once they are written. With `resume` a job
    that was stopped goes on from there: what is noted under the same settings is read, the rest is done.
    """
    spark = raw.sparkSession
    done = Manifest(spark, f"{out}/finished", resume)
    place = done.stage("feature_rows", {"keys": list(keys), "share": share, "seed": seed})
    if done.finished(place):
        train, test = read_split(spark, f"{out}/feature_rows")
    else:
        train, test = write_split(raw, f"{out}/feature_rows", keys, share, seed)
        done.finish(place)

    def fit_one(name, fit, train, own):
        place, path = done.stage(f"model-{name}", own), f"{out}/models/{name}"
        noted = done.finished(place)
        if noted:
            return read_model(path), noted["seconds"]
        model, seconds = timed_fit(name, fit, train, own)
        write_model(model, path)
        done.finish(place, seconds)
        return model, seconds

    fitted, summary, confusion = train_and_compare(train, test, settings, models, fit_one)
    release(spark)
    write_metrics(summary, f"{out}/model_results")
    report = class_report(confusion, "model")
    full = report.drop("code").unionByName(report_averages(report, "model"))
    write_metric_tables(f"{out}/model_comparison", summary=summary, confusion=confusion, report=full)
    best = summary.orderBy(F.desc("f1_weighted"), "model").first()["model"]  # a few rows
    place = done.stage("importance", {"best": best, "sample": sample, "repeats": repeats})
    if not done.finished(place):
        found = shuffled_importance(test, model_scorer(fitted[best]), rows=sample, repeats=repeats, seed=seed)
        write_importance(found, f"{out}/feature_importance")
        release(spark)
        done.finish(place)
    write_model(fitted[best], f"{out}/model")
    return best, summary, read_importance(spark, f"{out}/feature_importance")
