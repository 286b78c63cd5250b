"""Queries over splits, metrics, importance and the learned models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.catalog.base_sql import label, nearest, sql
from roadpulse.catalog.history import history, lean
from roadpulse.functions import columns as C
from roadpulse.operators import evaluation as E
from roadpulse.operators import learning as L
from roadpulse.operators.scoring import rule_scorer, with_prediction
from roadpulse.plans.batch import train_job, write_split
from roadpulse.session import scratch_path
from roadpulse.sources import artifacts as R
from roadpulse.sources import bindings as B

RULES = {
    "persistence": "traffic_lag_1h", "same_row_yesterday": "traffic_lag_24h", "trailing_mean": "traffic_rolling_3h",
}
# Sizes of the ensembles in these queries. Boosting and randomised trees have their published ones, the functions'
# defaults. The published forest (300 bagged trees of depth 15) takes over two minutes on the fixture on one machine.
SIZES = {"BoostedTrees": {}, "RandomForest": {"trees": 30, "depth": 8}, "RandomisedForest": {}}
QUICK_FOREST = {"trees": 20, "depth": 8}
FEATURE_CODES = ", ".join(f"('{f}')" for f in V.FEATURES)


def rule_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Actual and predicted class of every labelled row under three past-volume rules, one scan."""
    rules = F.array(*[
        F.struct(F.lit(m).alias("model"), C.nearest_code(F.col(c)).alias("predicted")) for m, c in RULES.items()
    ])
    return history(spark, d).select(F.col("congestion_code").alias("actual"), F.inline(rules))


def confusion(spark, d):
    return rule_predictions(spark, d).transform(E.confusion_matrix, "model")


def report(spark, d):
    return confusion(spark, d).transform(E.class_report, "model")


def summary(spark, d):
    return rule_predictions(spark, d).transform(E.summary_metrics, "model")


def _rates(df, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in ("precision", "recall", "f1") if c in df.columns})


def rule_importance(spark, d):
    return E.shuffled_importance(split_rows(spark, d)[1], rule_scorer())


def _rounded_importance(df):
    return df.select("feature", F.round("importance", 6).alias("importance"), F.round("std", 6).alias("std"))


def _importance_round_trip(spark, d):
    path = scratch_path(spark, "importance")
    R.write_importance(rule_importance(spark, d), path)
    return _rounded_importance(R.read_importance(spark, path))


def _importance_sink(spark, d):
    path = scratch_path(spark, "importance")
    R.write_importance(rule_importance(spark, d), path)
    return spark.read.text(path).agg(F.count_if(~F.col("value").startswith("feature,")).alias("n"))


def _metrics_json(spark, d):
    path = scratch_path(spark, "metrics")
    R.write_metrics(summary(spark, d), path)
    return R.read_metrics(spark, path).where(F.col("value").isNotNull())


def _nested(spark, d):
    """The nested metrics of the three rules, written and read back: summary, confusion cells, report."""
    path = scratch_path(spark, "nested-metrics")
    rep = report(spark, d)
    whole = rep.drop("code").unionByName(E.report_averages(rep, "model"))
    R.write_full_metrics(summary(spark, d), confusion(spark, d), whole, path)
    return R.read_full_metrics(spark, path)


def _metric_tables(spark, d):
    path = scratch_path(spark, "metric-tables")
    R.write_metric_tables(path, confusion=confusion(spark, d))
    return spark.read.parquet(f"{path}/confusion")


def split_rows(spark, d):
    return write_split(B.observations(spark, d), scratch_path(spark, "feature-rows"))


def _facts(spark, d, model, train, test):
    """Per class of the test rows: their number, and how many have sound probabilities (sum 1, the predicted class
    and the confidence at the largest), beside the rows that the persistence rule gets right."""
    scored = with_prediction(test, L.model_scorer(model))
    p = F.col("probabilities")
    top = F.array_max(p)
    ok = lambda c: C.flag(F.coalesce(c, F.lit(False)))
    rule = C.nearest_code(F.col("traffic_lag_1h"))
    marked = scored.select(
        F.col("congestion_code").alias("class_code"),
        ok(F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9).alias("sums"),
        ok((F.size(p) == len(V.CONGESTION_LABELS)) & (F.get(p, F.col("pred_code")) == top)).alias("tops"),
        ok(F.abs(F.col("confidence") - F.round(top * 100, 1)) < 1e-9).alias("sure"),
        ok(rule == F.col("congestion_code")).alias("rule_hit"),
    )
    return marked.groupBy("class_code").agg(
        F.count(F.lit(1)).alias("test_rows"), F.sum("sums").alias("n_sum_one"), F.sum("tops").alias("n_arg_max"),
        F.sum("sure").alias("n_confidence"), F.sum("rule_hit").alias("rule_hits"),
    )


def _fit(name):
    def run(spark, d):
        train, test = split_rows(spark, d)
        return _facts(spark, d, L.MODELS[name](train, **SIZES[name]), train, test)

    return run


def quarter_of_day():
    """A target that the features decide: which quarter of the day it is."""
    return F.expr("CAST(hour DIV 6 AS INT)")


def _learned_target(name, **settings):
    """The class that a model predicts for every test row after it was fitted to the quarter of the day."""

    def run(spark, d):
        train, test = (p.withColumn("congestion_code", quarter_of_day()) for p in split_rows(spark, d))
        model = L.MODELS[name](train, **settings)
        return with_prediction(test, L.model_scorer(model)).select("obs_id", F.col("pred_code").alias("predicted"))

    return run


def _predictions(name):
    """What a model says of every test row, beside the class and the persistence rule's answer."""

    def run(spark, d):
        train, test = split_rows(spark, d)
        scored = with_prediction(test, L.model_scorer(L.MODELS[name](train, **SIZES[name])))
        rule = C.nearest_code(F.col("traffic_lag_1h"))
        return scored.select("obs_id", F.col("congestion_code").alias("actual"), F.col("pred_code").alias("predicted"), "confidence", "probabilities", rule.alias("rule_predicted"))

    return run


def _early_stop(spark, d):
    """Training rows per class, and whether validation ended the boosting before its last round."""
    train, _ = split_rows(spark, d)
    model = L.boosted_trees(train, **SIZES["BoostedTrees"])
    n = train.groupBy(F.col("congestion_code").alias("class_code")).agg(F.count(F.lit(1)).alias("train_rows"))
    return n.withColumn("stopped", F.lit(int(model.rounds < 300)))


def _loss_by_round(spark, d):
    """The validation loss after each round of boosting that was measured, and which rounds the model keeps."""
    train, _ = split_rows(spark, d)
    model = L.boosted_trees(train, **SIZES["BoostedTrees"])
    losses = [(i + 1, loss, int(i < model.rounds)) for i, loss in enumerate(model.losses)]
    rows = train.agg(F.count(F.lit(1))).scalar()
    return spark.createDataFrame(losses, "round int, loss double, kept int").withColumn("train_rows", rows)


def _quick_forest(spark, d):
    train, test = split_rows(spark, d)
    return with_prediction(test, L.model_scorer(L.random_forest(train, **QUICK_FOREST)))


def _class_probabilities(spark, d):
    """Per test row, whether its four printed percentages add up to 100 within rounding."""
    p = F.col("probabilities")
    shown = [F.round(p[i] * 100, 1) for i in range(len(V.CONGESTION_LABELS))]
    return _quick_forest(spark, d).select("obs_id", C.flag(F.abs(sum(shown) - 100) < 0.21).alias("adds_up"))


def _confidence(spark, d):
    """Per test row, whether its confidence is the percentage of its predicted class and at least a quarter."""
    sure = F.round(F.get("probabilities", F.col("pred_code")) * 100, 1) == F.col("confidence")
    return _quick_forest(spark, d).select("obs_id", C.flag(sure & (F.col("confidence") >= 25)).alias("sound"))


def _compare(spark, d):
    train, test = split_rows(spark, d)
    _, metrics, confusion_ = L.train_and_compare(train, test, COMPARED)
    rows = confusion_.groupBy("model").agg(F.sum("n").alias("test_rows"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    board = E.leaderboard(metrics).join(rows, "model")
    fits = F.abs(F.col("accuracy") - F.round(F.col("hits") / F.col("test_rows"), 4)) < 1e-9
    return board.select("model", "test_rows", C.flag(fits).alias("accuracy_fits"))


def _model_round_trip(spark, d):
    train, test = split_rows(spark, d)
    model, path = L.random_forest(train, **QUICK_FOREST), scratch_path(spark, "model")
    R.write_model(model, path)
    first = L.model_scorer(model)(test).select("obs_id", F.col("pred_code").alias("a"))
    again = L.model_scorer(R.read_model(path))(test).select("obs_id", F.col("pred_code").alias("b"))
    return first.join(again, "obs_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("n_same"))


def _train_job(spark, d):
    """The features ranked by the job, whether its artifacts agree, with all three models compared."""
    out = scratch_path(spark, "training")
    best, _, _ = train_job(B.observations(spark, d), out, settings=COMPARED)
    importance = R.read_importance(spark, f"{out}/feature_importance")
    metrics = R.read_metrics(spark, f"{out}/model_results").where("metric = 'f1_weighted'")
    top = metrics.agg(F.max(F.struct("value", "model")).alias("t")).scalar()
    n_models = metrics.agg(F.countDistinct("model")).scalar()
    return importance.select("feature", n_models.alias("models"), C.flag(top["model"] == best).alias("best_is_top"))


# What the comparing queries fit, all three models.
COMPARED = {
    "BoostedTrees": {}, "RandomForest": {"trees": 20, "depth": 8}, "RandomisedForest": {"trees": 40},
}

QUERIES = {
    "s2_importance_csv": _importance_round_trip,
    "s3_metrics_json": _metrics_json,
    "s3_nested_confusion": lambda s, d: _nested(s, d)[1],
    "s3_nested_report": lambda s, d: _rates(_nested(s, d)[2]).withColumn("support", F.col("support").cast("long")),
    "s4_importance_sink": _importance_sink,
    "s5_metric_tables": _metric_tables,
    "s6_model_round_trip": _model_round_trip,
    "m1_stratified_split": lambda s, d: lean(s, d).transform(E.stratified_split).select("obs_id", "congestion_code", "is_test"),
    "m2_boosted_trees": _fit("BoostedTrees"),
    "m2_learned_target": _learned_target("BoostedTrees", max_iter=40),
    "m2_predictions": _predictions("BoostedTrees"),
    "m3_early_stopping": _early_stop,
    "m3_loss_by_round": _loss_by_round,
    "m4_random_forest": _fit("RandomForest"),
    "m5_randomised_forest": _fit("RandomisedForest"),
    "m5_predictions": _predictions("RandomisedForest"),
    "m6_class_weights": lambda s, d: lean(s, d).transform(E.class_weights).select(
        "congestion_code", "n", F.round("weight", 9).alias("weight")),
    "m7_class_probabilities": _class_probabilities,
    "m8_confidence": _confidence,
    "m9_accuracy": lambda s, d: rule_predictions(s, d).where(F.col("model") == "persistence").transform(E.accuracy),
    "m10_confusion_matrix": confusion,
    "m11_class_report": lambda s, d: _rates(report(s, d)).drop("code"),
    "m11_report_averages": lambda s, d: _rates(report(s, d).transform(E.report_averages, "model")),
    "m12_weighted_f1": lambda s, d: report(s, d).transform(E.weighted_f1, "model").select(
        "model", F.round("f1_weighted", 6).alias("f1_weighted")),
    "m13_train_and_compare": _compare,
    "m14_permutation_importance": lambda s, d: _rounded_importance(rule_importance(s, d)),
    "m15_training_job": _train_job,
    "m16_leaderboard": lambda s, d: summary(s, d).transform(E.leaderboard),
    "m16_best_model": lambda s, d: summary(s, d).transform(E.best_model),
    "m16_top_features": lambda s, d: rule_importance(s, d).transform(E.top_features, 10).select(
        "feature", F.round("importance", 6).alias("importance")),
    "m17_per_class_long": lambda s, d: report(s, d).transform(E.per_class_long).withColumn("value", F.round("value", 6)),
    "m17_six_axes": lambda s, d: confusion(s, d).transform(E.six_axes).withColumns(
        {f"{n.lower()}_f1": F.round(f"{n.lower()}_f1", 6) for n in V.CONGESTION_LABELS}),
    "m18_persistence": lambda s, d: with_prediction(history(s, d), rule_scorer()).select(
        "obs_id", "congestion_code", "pred_code", "label"),
}

_F1 = """coalesce(sum(CASE WHEN p + a > 0 THEN 2.0e0 * h / (p + a) ELSE 0 END * a) / sum(a), 0)"""
_IMPORTANCE = f""",
class_size AS (SELECT congestion_code AS c, ceil(count(*) * 0.15e0) AS want FROM hist GROUP BY 1),
numbered AS (SELECT obs_id, congestion_code AS y, traffic_lag_1h AS v,
  row_number() OVER (PARTITION BY congestion_code ORDER BY md5('42-' || obs_id), obs_id) AS r FROM hist),
test_rows AS (SELECT obs_id, y, v FROM numbered JOIN class_size ON y = c WHERE r <= want),
sample AS (SELECT *, row_number() OVER (ORDER BY md5('42-receiver-' || obs_id), obs_id) AS pos FROM test_rows),
trial AS (SELECT f AS feature, r AS repeat FROM (VALUES {FEATURE_CODES}) t(f) CROSS JOIN (SELECT range AS r FROM range(5))),
donor AS (SELECT feature, repeat, v, row_number() OVER (PARTITION BY feature, repeat
  ORDER BY md5('42-' || feature || '-' || repeat || '-' || obs_id), obs_id) AS pos FROM sample CROSS JOIN trial),
guess AS (SELECT d.feature, d.repeat, s.y,
  {nearest("(CASE WHEN d.feature = 'traffic_lag_1h' THEN d.v ELSE s.v END)")} AS p FROM sample s JOIN donor d ON s.pos = d.pos
  UNION ALL SELECT '', -1, y, {nearest('v')} FROM sample),
cell AS (SELECT feature, repeat, c, CAST(count(*) FILTER (WHERE y = c AND p = c) AS DOUBLE) AS h,
  CAST(count(*) FILTER (WHERE y = c) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE p = c) AS DOUBLE) AS p
  FROM guess CROSS JOIN codes GROUP BY 1, 2, 3),
f1s AS (SELECT feature, repeat, {_F1} AS f1 FROM cell GROUP BY 1, 2),
imp AS (SELECT feature, round(avg(b.f1 - f1s.f1), 6) AS importance, round(stddev_pop(b.f1 - f1s.f1), 6) AS std
  FROM f1s, (SELECT f1 FROM f1s WHERE feature = '') b WHERE feature <> '' GROUP BY 1)
"""


def _importance_sql(query: str) -> str:
    return sql("SELECT 1").removesuffix("SELECT 1").rstrip() + _IMPORTANCE + query


_REP = f"SELECT model, {label('c')} AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rep"


def _facts_sql() -> str:
    return sql(f"""SELECT congestion_code AS class_code, count(*) AS test_rows, count(*) AS n_sum_one, count(*) AS n_arg_max,
        count(*) AS n_confidence, CAST(count(*) FILTER (WHERE rule = congestion_code) AS BIGINT) AS rule_hits
        FROM (SELECT congestion_code, CAST({nearest('traffic_lag_1h')} AS INTEGER) AS rule, count(*) OVER (PARTITION BY congestion_code) AS n,
        row_number() OVER (PARTITION BY congestion_code ORDER BY md5('42-' || obs_id), obs_id) AS r FROM hist)
        WHERE r <= ceil(n * 0.15e0) GROUP BY 1""")


def _test_rows(columns: str, where: str = "r <= ceil(n * 0.15e0)", tail: str = "") -> str:
    return sql(f"""SELECT {columns} FROM (SELECT obs_id, congestion_code, count(*) OVER (PARTITION BY congestion_code) AS n,
        row_number() OVER (PARTITION BY congestion_code ORDER BY md5('42-' || obs_id), obs_id) AS r FROM lab) WHERE {where} {tail}""")


ORACLE = {
    "m2_boosted_trees": _facts_sql(),
    "m2_learned_target": sql("""SELECT obs_id, CAST(extract(hour FROM date_time) // 6 AS INTEGER) AS predicted FROM (SELECT obs_id, date_time,
        count(*) OVER (PARTITION BY congestion_code) AS n, row_number() OVER (PARTITION BY congestion_code ORDER BY md5('42-' || obs_id), obs_id) AS r
        FROM lab) WHERE r <= ceil(n * 0.15e0)"""),
    "m3_early_stopping": _test_rows("congestion_code AS class_code, count(*) AS train_rows, 1 AS stopped", "r > ceil(n * 0.15e0)", "GROUP BY 1"),
    "m4_random_forest": _facts_sql(),
    "m5_randomised_forest": _facts_sql(),
    "m7_class_probabilities": _test_rows("obs_id, 1 AS adds_up"),
    "m8_confidence": _test_rows("obs_id, 1 AS sound"),
    "m13_train_and_compare": _test_rows(
        "m AS model, count(*) AS test_rows, 1 AS accuracy_fits",
        tail="GROUP BY 1").replace("FROM (SELECT obs_id, congestion_code, count(*)", "FROM (SELECT unnest(['BoostedTrees', 'RandomForest', 'RandomisedForest'])"
        " AS m, obs_id, congestion_code, n, r FROM (SELECT obs_id, congestion_code, count(*)").replace("FROM lab) WHERE", "FROM lab)) WHERE"),
    "m15_training_job": f"SELECT f AS feature, 3 AS models, 1 AS best_is_top FROM (VALUES {FEATURE_CODES}) t(f)",
    "s2_importance_csv": _importance_sql("SELECT * FROM imp"),
    "s3_metrics_json": sql("""SELECT model, 'accuracy' AS metric, accuracy AS value FROM summ
        UNION ALL SELECT model, 'f1_weighted', f1_weighted FROM summ"""),
    "s3_nested_confusion": sql("SELECT * FROM conf"),
    "s4_importance_sink": f"SELECT count(*) AS n FROM (VALUES {FEATURE_CODES}) t(f)",
    "s5_metric_tables": sql("SELECT * FROM conf"),
    "s6_model_round_trip": sql("""SELECT CAST(sum(w) AS BIGINT) AS n, CAST(sum(w) AS BIGINT) AS n_same
        FROM (SELECT ceil(count(*) * 0.15e0) AS w FROM lab GROUP BY congestion_code)"""),
    "m1_stratified_split": sql("""SELECT obs_id, congestion_code, CAST(r <= ceil(n * 0.15e0) AS INTEGER) AS is_test FROM (
        SELECT obs_id, congestion_code, count(*) OVER (PARTITION BY congestion_code) AS n,
        row_number() OVER (PARTITION BY congestion_code ORDER BY md5('42-' || obs_id), obs_id) AS r FROM lab)"""),
    "m6_class_weights": sql("""SELECT congestion_code, count(*) AS n, round((SELECT count(*) FROM lab)
        / ((SELECT count(DISTINCT congestion_code) FROM lab) * count(*)), 9) AS weight FROM lab GROUP BY 1"""),
    "m9_accuracy": sql("SELECT round(avg(CAST(actual = predicted AS INTEGER)), 4) AS accuracy FROM three WHERE model = 'persistence'"),
    "m10_confusion_matrix": sql("SELECT * FROM conf"),
    "m11_class_report": sql(_REP),
    "m11_report_averages": sql("""SELECT model, 'macro avg' AS class, round(avg(precision), 6) AS precision,
        round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM rep GROUP BY 1
        UNION ALL SELECT model, 'weighted avg', round(sum(precision * support) / sum(support), 6),
        round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
        CAST(sum(support) AS BIGINT) FROM rep GROUP BY 1"""),
    "s3_nested_report": sql(_REP + """ UNION ALL SELECT model, 'macro avg', round(avg(precision), 6), round(avg(recall), 6),
        round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM rep GROUP BY 1
        UNION ALL SELECT model, 'weighted avg', round(sum(precision * support) / sum(support), 6),
        round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM rep GROUP BY 1"""),
    "m12_weighted_f1": sql("SELECT model, round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM rep GROUP BY 1"),
    "m14_permutation_importance": _importance_sql("SELECT * FROM imp"),
    "m16_leaderboard": sql("""SELECT *, CAST(position = 1 AS INTEGER) AS is_best FROM (SELECT *,
        CAST(row_number() OVER (ORDER BY f1_weighted DESC, model) AS INTEGER) AS position FROM summ)"""),
    "m16_best_model": sql("""SELECT model AS best_model, f1_weighted, 27 AS feature_count FROM summ
        ORDER BY f1_weighted DESC, model LIMIT 1"""),
    "m16_top_features": _importance_sql("SELECT feature, importance FROM imp ORDER BY importance DESC, feature LIMIT 10"),
    "m17_per_class_long": sql("""SELECT model, class, metric, value FROM (
        UNPIVOT (SELECT model, class, precision, recall, f1, CAST(support AS DOUBLE) AS support FROM (""" + _REP + """))
        ON precision, recall, f1, support INTO NAME metric VALUE value)"""),
    "m17_six_axes": sql("SELECT model, accuracy, f1_weighted AS weighted_f1, " + ", ".join(
        f"(SELECT round(f1, 6) FROM rep WHERE rep.model = summ.model AND c = {i}) AS {n.lower()}_f1"
        for i, n in enumerate(V.CONGESTION_LABELS)) + " FROM summ"),
    "m18_persistence": sql(f"""SELECT *, {label('pred_code')} AS label FROM (SELECT obs_id, congestion_code,
        CAST({nearest('traffic_lag_1h')} AS INTEGER) AS pred_code FROM hist)"""),
}
