"""Metric operators on the published matrices; fits, importance and persistence on the fixture."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpulse import fixed_values as V
from roadpulse.catalog import models as M
from roadpulse.operators import evaluation as E
from roadpulse.operators import histogram_trees as H
from roadpulse.operators import learning as L
from roadpulse.operators.scoring import rule_scorer
from roadpulse.sources import artifacts as R

# Three published confusion matrices with accuracy and weighted F1.
MATRICES = {
    "Boosting": ([[1622, 27, 0, 0], [39, 859, 80, 0], [1, 76, 1862, 121], [0, 1, 111, 2430]], 0.9369, 0.9368),
    "RandomForest": ([[1592, 55, 2, 0], [25, 899, 54, 0], [1, 133, 1803, 123], [2, 7, 137, 2396]], 0.9254, 0.9259),
    "ExtraTrees": ([[1574, 71, 4, 0], [30, 883, 62, 3], [0, 166, 1730, 164], [0, 5, 141, 2396]], 0.9106, 0.9111),
}


@pytest.fixture(scope="module")
def matrices(spark):
    cells = [(m, a, p, n) for m, (t, *_) in MATRICES.items() for a, row in enumerate(t) for p, n in enumerate(row)]
    df = spark.createDataFrame(cells, "model string, actual int, predicted int, n int")
    many = F.explode(F.array_repeat(F.lit(0), F.col("n")))
    return df.where("n > 0").select("model", "actual", "predicted", many.alias("x")).drop("x")


def test_published_metrics(matrices):
    got = {r.model: (r.accuracy, r.f1_weighted) for r in E.summary_metrics(matrices, "model").collect()}
    assert got == {m: (a, f) for m, (_, a, f) in MATRICES.items()}


def test_published_class_report(matrices):
    rep = E.class_report(E.confusion_matrix(matrices, "model"), "model").where("model = 'Boosting'").orderBy("code").collect()
    assert [round(r.f1, 6) for r in rep] == [0.979764, 0.885111, 0.905422, 0.954251]
    assert [r.support for r in rep] == [1649, 978, 2060, 2542]


def test_confusion_margins_are_supports(matrices):
    conf = E.confusion_matrix(matrices, "model")
    assert conf.count() == 48
    margins = {(r.model, r.actual): r.s for r in conf.groupBy("model", "actual").agg(F.sum("n").alias("s")).collect()}
    for r in E.class_report(conf, "model").collect():
        assert margins[(r.model, r.code)] == r.support


def test_zero_division_gives_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "actual int, predicted int")
    rep = {r["class"]: (r.precision, r.recall, r.f1) for r in E.class_report(E.confusion_matrix(df)).collect()}
    assert rep["Severe"] == (0.0, 0.0, 0.0) and rep["Medium"] == (0.0, 0.0, 0.0)


def test_best_model_takes_first_name_on_ties(spark):
    df = spark.createDataFrame([("b", 0.5, 0.5), ("a", 0.5, 0.5)], "model string, accuracy double, f1_weighted double")
    assert E.best_model(df).first().best_model == "a"


@pytest.mark.parametrize("share", [0.15, 0.5, 1.0])
def test_split_is_exact_per_class(spark, share):
    df = spark.range(997).select(F.col("id").alias("obs_id"), F.when(F.col("id") < 700, 0).otherwise((F.col("id") % 3).cast("int")).alias("congestion_code"))
    got = E.stratified_split(df, share).groupBy("congestion_code").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_test").alias("t")
    ).collect()
    for r in got:
        assert r.t == math.ceil(r.n * share)
    assert E.stratified_split(df, share).count() == 997


@pytest.fixture(scope="module")
def parts(spark):
    return M.split_rows(spark, "/root/testdata/sf0.01")


def _f1(df, scorer):
    return E.summary_metrics(L.predictions(df, scorer)).first().f1_weighted


def test_models_beat_persistence(parts):
    """On a target that the features decide, every ensemble beats the persistence rule."""
    clear = F.when(F.col("hour") < 6, 0).when(F.col("hour") < 12, 1).when(F.col("hour") < 18, 2).otherwise(3)
    train, test = (p.withColumn("congestion_code", clear).persist() for p in parts)
    base = _f1(test, rule_scorer())
    small = {
        "BoostedTrees": {"max_iter": 4, "depth": 3}, "RandomForest": {"trees": 8, "depth": 5},
        "RandomisedForest": {"trees": 8, "depth": 6},
    }
    for name, fit in L.MODELS.items():
        scorer = L.model_scorer(fit(train, **small[name]))
        scored = scorer(test).select("pred_code", "probabilities")
        assert scored.where(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-6).count() == 0
        assert _f1(test, scorer) > base + 0.2, name


def test_noise_ranks_last(parts):
    train, test = (p.withColumn("congestion_code", F.when(F.col("hour") < 12, 0).otherwise(3)) for p in parts)
    noise = lambda df: df.withColumn("noise", F.rand(7))
    use = ("hour", "traffic_lag_1h", "noise")
    model = L.random_forest(noise(train), trees=5, depth=3, features=use)
    imp = E.permutation_importance(noise(test).persist(), L.model_scorer(model), features=use, rows=500, repeats=3)
    got = {r.feature: (r.importance, r.std) for r in imp.collect()}
    assert set(got) == set(use) and got["hour"][0] > 0.2 and abs(got["noise"][0]) < 0.05


def test_importance_by_hand(spark):
    """Values move round their block: counted row by row, with blocks of one row, a tie of keys and an empty table."""
    features, n = ("a", "b"), 40
    rows = [(i if i < n - 1 else 0, i % 3, float(i % 3), float(i % 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "obs_id long, congestion_code int, a double, b double")

    def scorer(d):
        return d.withColumn("pred_code", F.pmod(F.col("a") + F.floor(F.col("b") / 4), F.lit(3)).cast("int"))

    def number(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)

    def f1(pairs):
        total = 0.0
        for c in range(3):
            hit, a, p = (sum(map(f, pairs)) for f in (lambda x: x == (c, c), lambda x: x[0] == c, lambda x: x[1] == c))
            total += 2 * hit / (a + p) * a if a + p else 0.0
        return total / len(pairs)

    guess = lambda x: int((x[0] + x[1] // 4) % 3)
    for block_rows in (1, 7, 100):
        blocks = {}
        for r in rows:
            name = f"42-receiver-{r[0]}"
            blocks.setdefault(number(name) % max(1, n // block_rows), []).append((hashlib.md5(name.encode()).hexdigest(), *r))
        want = {}
        for j, f in enumerate(features):
            for repeat in range(2):
                pairs = []
                for b, held in blocks.items():
                    held.sort()
                    shift = number(f"42-shift-{f}-{repeat}-{b}") % max(len(held) - 1, 1) + 1
                    for i, r in enumerate(held):
                        x = list(r[3:])
                        x[j] = held[(i + shift) % len(held)][3 + j]
                        pairs.append((r[2], guess(x)))
                want.setdefault(f, []).append(f1([(r[1], guess(r[2:])) for r in rows]) - f1(pairs))
        got = E.permutation_importance(df, scorer, features=features, repeats=2, block_rows=block_rows).collect()
        assert {r.feature: round(r.importance, 9) for r in got} == {f: round(sum(d) / 2, 9) for f, d in want.items()}
    assert E.permutation_importance(df.limit(0), scorer, features=features).count() == 0


def test_importance_shuffles_the_test_rows_once(spark):
    df = spark.range(100).select(F.col("id").alias("obs_id"), (F.col("id") % 4).cast("int").alias("congestion_code"), F.rand(1).alias("a"))
    found = E.permutation_importance(df, lambda d: d.withColumn("pred_code", F.lit(1)), features=("a",))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("collect_list") == 1


def test_shuffled_importance_by_hand(spark):
    """Values move over the whole table, not within blocks: counted row by row, ranked in one part and in several, with a null, and an empty table."""
    features, n = ("a", "b"), 1100
    rows = [(i, i % 3, float(i % 3), None if i == 5 else float(i % 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "obs_id long, congestion_code int, a double, b double")

    def scorer(d):
        return d.withColumn("pred_code", F.pmod(F.col("a") + F.floor(F.coalesce("b", F.lit(0.0)) / 4), F.lit(3)).cast("int"))

    def order(text):
        return sorted(rows, key=lambda r: hashlib.md5(f"42-{text}{r[0]}".encode()).hexdigest())

    def f1(pairs):
        total = 0.0
        for c in range(3):
            hit, a, p = (sum(map(f, pairs)) for f in (lambda x: x == (c, c), lambda x: x[0] == c, lambda x: x[1] == c))
            total += 2 * hit / (a + p) * a if a + p else 0.0
        return total / len(pairs)

    guess = lambda x: int((x[0] + (x[1] or 0) // 4) % 3)
    want, receivers = {}, order("receiver-")
    for j, f in enumerate(features):
        for repeat in range(2):
            pairs = []
            for r, donor in zip(receivers, order(f"{f}-{repeat}-")):
                x = list(r[2:])
                x[j] = donor[2 + j]
                pairs.append((r[1], guess(x)))
            want.setdefault(f, []).append(f1([(r[1], guess(r[2:])) for r in rows]) - f1(pairs))
    want = {f: round(sum(d) / 2, 9) for f, d in want.items()}
    ranked = E.RANKED
    try:
        for E.RANKED in (2, ranked):
            got = E.shuffled_importance(df, scorer, features=features, repeats=2).collect()
            assert {r.feature: round(r.importance, 9) for r in got} == want
    finally:
        E.RANKED = ranked
    assert E.shuffled_importance(df.limit(0), scorer, features=features).count() == 0


def test_artifacts_round_trip(spark, matrices, tmp_path):
    assert R.read_importance(spark, str(tmp_path / "none")) is None
    summary = E.summary_metrics(matrices, "model").withColumn("train_time_sec", F.lit(1.5))
    R.write_metrics(summary, str(tmp_path / "m"))
    assert R.read_metrics(spark, str(tmp_path / "m")).count() == 9
    nested = (
        '{"Boosting": {"accuracy": 0.9, "f1_weighted": 0.8, "train_time_sec": 5.0, "confusion_matrix": '
        '[[1,2,0,0],[0,3,0,0],[0,0,4,0],[0,0,0,5]], "classification_report": {"Low": {"precision": 0.5, '
        '"recall": 0.25, "f1-score": 0.3, "support": 3.0}, "accuracy": 0.9}}}'
    )
    (tmp_path / "full.json").write_text(nested)
    s, cells, report = R.read_full_metrics(spark, str(tmp_path / "full.json"))
    assert s.first().accuracy == 0.9
    assert cells.where("actual = 0 and predicted = 1").first().n == 2 and cells.count() == 16
    assert report.where("class = 'Low'").first().f1 == 0.3


def test_training_job_writes_everything(spark, tmp_path):
    from roadpulse.plans.batch import train_job
    from roadpulse.sources.bindings import observations

    best, summary, importance = train_job(
        observations(spark, "/root/testdata/sf0.001"), str(tmp_path), sample=100, repeats=2,
        models={"RandomForest": L.random_forest}, settings={"RandomForest": {"trees": 3, "depth": 3}},
    )
    assert best == "RandomForest" and importance.count() == len(V.FEATURES)
    assert R.read_importance(spark, str(tmp_path / "feature_importance")).count() == len(V.FEATURES)
    assert L.model_scorer(R.read_model(str(tmp_path / "model")))(spark.read.parquet(str(tmp_path / "feature_rows"))).count() > 0
    assert spark.read.parquet(str(tmp_path / "model_comparison" / "report")).count() == 6


def test_killed_training_job_goes_on(spark, tmp_path):
    """Stopped in its third fit: the rows and two models are read, the rest is done, as without the stop."""
    from roadpulse.plans.batch import train_job
    from roadpulse.sources.bindings import observations

    raw, calls = observations(spark, "/root/testdata/sf0.001"), []
    sizes = {"RandomForest": {"trees": 3, "depth": 3}, "RandomisedForest": {"trees": 3, "depth": 3}, "BoostedTrees": {"max_iter": 2, "depth": 2}}

    def fits(stop=()):
        def counted(name):
            def fit(train, **own):
                calls.append(name)
                if name in stop:
                    raise RuntimeError("killed")
                return L.MODELS[name](train, **own)
            return fit
        return {name: counted(name) for name in sizes}

    def job(out, stop=(), settings=sizes, **more):
        best, summary, importance = train_job(raw, str(tmp_path / out), models=fits(stop), settings=settings, sample=60, repeats=1, **more)
        return best, sorted(tuple(r) for r in summary.drop("train_time_sec").collect()), sorted(tuple(r) for r in importance.collect())

    whole = job("whole")
    calls.clear()
    with pytest.raises(RuntimeError):
        job("cut", stop=("BoostedTrees",))
    assert calls == list(sizes)
    rows = {p: p.stat().st_mtime_ns for p in (tmp_path / "cut" / "feature_rows").rglob("*.parquet")}
    calls.clear()
    assert job("cut", resume=True) == whole and calls == ["BoostedTrees"]
    assert rows == {p: p.stat().st_mtime_ns for p in (tmp_path / "cut" / "feature_rows").rglob("*.parquet")}
    calls.clear()
    assert job("cut", resume=True) == whole and calls == []
    # other settings of the second model: it and what follows it is done again
    job("cut", settings={**sizes, "RandomisedForest": {"trees": 2, "depth": 2}}, resume=True)
    assert calls == ["RandomisedForest", "BoostedTrees"]
    calls.clear()
    job("cut")
    assert calls == list(sizes)


def separable(spark, classes, n=400):
    rows = [(i, classes[i % len(classes)], float(classes[i % len(classes)] * 10 + i % 7), float(i % 5)) for i in range(n)]
    return spark.createDataFrame(rows, "obs_id long, congestion_code int, x double, y double")


FITS = {
    "RandomForest": lambda df: L.random_forest(df, trees=7, depth=4, features=("x", "y")),
    "RandomisedForest": lambda df: L.randomised_forest(df, trees=7, depth=4, features=("x", "y")),
    "BoostedTrees": lambda df: L.boosted_trees(df, max_iter=3, depth=3, step=0.5, features=("x", "y")),
}


@pytest.mark.parametrize("name", FITS)
@pytest.mark.parametrize("classes", [(0, 1, 2), (0, 1, 3)])
def test_absent_classes(spark, name, classes):
    df = separable(spark, classes)
    got = L.model_scorer(FITS[name](df))(df).select("congestion_code", "pred_code", "probabilities").collect()
    assert all(len(r.probabilities) == 4 and abs(sum(r.probabilities) - 1) < 1e-9 for r in got)
    assert sum(r.congestion_code == r.pred_code for r in got) > 0.97 * len(got)


@pytest.mark.parametrize("name", FITS)
def test_fit_does_not_depend_on_partitions(spark, name):
    df = separable(spark, (0, 1, 2, 3)).withColumn("x", F.col("x") + F.rand(3) * 15).persist()
    a, b = (L.model_scorer(FITS[name](df.repartition(n)))(df).select("obs_id", "probabilities") for n in (4, 13))
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_all_trees_are_grown(spark):
    assert len(L.randomised_forest(separable(spark, (0, 1, 2, 3), 80), trees=11, depth=2, features=("x", "y"), together=4).trees) == 11


def test_patience():
    assert H.patient_rounds([5, 4, 3, 3.5, 3.4, 3.2, 1], 3) == (3, True)
    assert H.patient_rounds([5, 4, 3, 3.5, 3.4, 2, 1], 3) == (7, False)
    assert H.patient_rounds([1], 20) == (1, False)


# --- trees from histograms ------------------------------------------------------------------------------------

USE = ("hour", "day_of_week", "temp_celsius", "traffic_lag_1h")


def _same(a, b):
    return len(a.trees) == len(b.trees) and all(
        np.array_equal(x.feature, y.feature) and np.array_equal(x.cut, y.cut) and np.array_equal(x.left, y.left) and np.array_equal(x.value, y.value)
        for x, y in zip(a.trees, b.trees)
    )


@pytest.fixture(scope="module")
def decided(parts):
    """Rows whose class the features decide, but for a tenth."""
    noise = F.pmod(F.xxhash64("obs_id"), F.lit(40))
    rule = F.when(noise < 4, noise.cast("int")).when(F.col("hour") * 300 + F.col("traffic_lag_1h") < 3500, 0).when(F.col("temp_celsius") < 2, 1).otherwise(F.when(F.col("day_of_week") < 3, 2).otherwise(3))
    return [p.withColumn("congestion_code", rule).persist() for p in parts]


@pytest.mark.parametrize("fit, settings", [
    (L.boosted_trees, {"max_iter": 3, "depth": 4}), (L.randomised_forest, {"trees": 5, "depth": 7}),
])
def test_growth_is_the_same_from_histograms_and_in_one_task(decided, fit, settings):
    train = decided[0]
    one = fit(train, features=USE, **settings)
    assert _same(one, fit(train, features=USE, fits=700, parts=3, **settings))
    assert _same(one, fit(train.repartition(5), features=USE, fits=0, **settings))


def test_boosting_learns_and_stops(decided):
    train, test = decided
    model = L.boosted_trees(train, features=USE)
    assert model.rounds < len(model.losses) < 300 and model.losses[model.rounds - 1] == min(model.losses[: model.rounds + 20])
    assert all(len(t.feature) <= 61 for t in model.trees)  # 31 leaves
    assert E.summary_metrics(L.predictions(test, L.model_scorer(model))).first().accuracy > 0.9


def test_first_round_is_the_best_newton_step(decided):
    """The first tree of each class, one split deep, against all cuts of all features tried one by one."""
    train = decided[0]
    model = L.boosted_trees(train, features=USE[:2], max_iter=1, depth=1, step=1.0)
    table = train.withColumn("v", L.validation_bucket(42, "obs_id") < L.VALIDATION_CUT).where("NOT v").select("congestion_code", *USE[:2]).toPandas()
    y, shares = table["congestion_code"].to_numpy(), np.bincount(table["congestion_code"], minlength=4) / len(table)
    assert np.allclose(np.exp(model.start), shares)
    for c in range(4):
        g, h = shares[c] - (y == c), np.full(len(y), shares[c] * (1 - shares[c]))
        score = lambda use: g[use].sum() ** 2 / (h[use].sum() + 0.1)  # noqa: B023,E731
        best = max(
            (score(left) + score(~left), f, cut) for f in USE[:2] for cut in np.unique(table[f])[:-1]
            for left in [table[f].to_numpy() <= cut] if min(left.sum(), (~left).sum()) >= 20
        )
        tree = model.trees[c]
        assert model.features[tree.feature[0]] == best[1] and best[2] < tree.cut[0] < best[2] + 1
        left = table[best[1]].to_numpy() <= best[2]
        assert np.allclose(tree.value[1:, 0], [-g[s].sum() / (h[s].sum() + 0.1) for s in (left, ~left)], atol=1e-4)


def test_random_thresholds_differ_by_node_and_tree(decided):
    model = L.randomised_forest(decided[0], features=USE, trees=6, depth=8)
    assert not any(_same(H.TreeEnsemble([], [a]), H.TreeEnsemble([], [b])) for i, a in enumerate(model.trees) for b in model.trees[:i])
    for tree in model.trees:
        cuts = {f: [c for g, c in zip(tree.feature, tree.cut) if g == f] for f in range(len(USE))}
        assert any(len(set(c)) > 3 for c in cuts.values())  # a tree's nodes cut a feature at different places
        deep = np.bincount(tree.feature[tree.feature >= 0], minlength=len(USE))
        assert (deep > 0).all()
    for tree in model.trees:  # every leaf holds shares of the classes
        assert np.allclose(tree.value.sum(axis=1), 1)


def test_ensembles_round_trip_as_tables(spark, decided, tmp_path):
    for i, model in enumerate((L.boosted_trees(decided[0], features=USE, max_iter=2, depth=3), L.randomised_forest(decided[0], features=USE, trees=2, depth=4))):
        R.write_model(model, str(tmp_path / str(i)))
        again = R.read_model(str(tmp_path / str(i)))
        assert _same(model, again) and again.start == model.start and again.features == model.features


def test_ensembles_of_few_rows(spark):
    schema = "obs_id long, congestion_code int, a double"
    none = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(i, 2, float(i)) for i in range(50)], schema)
    gaps = spark.createDataFrame([(i, 3 * (i % 2), None if i % 2 else float(i)) for i in range(400)], schema)
    for train, want in ((one, 2), (gaps, None)):
        for model in (L.boosted_trees(train, features=("a",), max_iter=4), L.randomised_forest(train, features=("a",), trees=3)):
            got = {r.pred_code for r in L.model_scorer(model)(train).collect()}
            assert got == ({want} if want is not None else {0, 3})
    for model in (L.boosted_trees(none, features=("a",), max_iter=4), L.randomised_forest(none, features=("a",), trees=3)):
        assert L.model_scorer(model)(one).select(F.size("probabilities").alias("n")).distinct().collect()[0].n == 4


def test_best_first_growth_opens_no_more_than_it_keeps():
    """Against a growth of all nodes that is cut back afterwards; the whole growth has far more nodes."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (3000, 4)).astype(np.uint8)
    values = np.stack([rng.integers(-H.UNIT, H.UNIT, 3000), rng.integers(1, H.UNIT // 4, 3000)], axis=1).astype(np.int32)
    rule = H.Boosting(0.1, 5, 8)
    limited, whole = (list(rule.grown(x, values, 0, 1, 9, leaves)) for leaves in (31, None))
    assert len(limited) == 61 < len(whole)
    nodes = lambda found: {n[0]: n[1:] for n in found}
    assert _same(H.TreeEnsemble([], [H.assembled(nodes(limited), leaves=31)]), H.TreeEnsemble([], [H.assembled(nodes(whole), leaves=31)]))
    sums = rule.histograms(x, values, np.arange(3000) % 3, 3, 9)
    for s in range(3):
        for b in range(9):
            use = (np.arange(3000) % 3 == s) & (x[:, 2] == b)
            assert sums[s, 2, b].tolist() == [*values[use].sum(axis=0, dtype=np.int64).tolist(), int(use.sum())]


def test_random_nodes_of_a_level_are_those_one_by_one():
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 7, (900, 5)).astype(np.uint8), rng.integers(0, 4, (900, 1)).astype(np.uint8)
    x[:, 3] = 2  # varies nowhere
    rule = H.Randomised((1.0, 2.0, 0.5, 1.5), tuple(tuple(np.arange(0.5, 6.5)) for _ in range(5)), 3, 6, 2, 42)
    found = {}
    for numbers, *arrays in rule.grown(x, y, 1, 1, 7, None):
        found |= {k: rest for k, *rest in zip(numbers.tolist(), *arrays)}

    def walk(k, rows):
        hist = rule.histograms(x[rows], y[rows], np.zeros(len(rows), np.int64), 1, 7)[0]
        total = hist[0].sum(axis=0)
        split = rule.split(hist, total, 1, k) if k.bit_length() <= 6 and len(rows) >= 6 else None
        f, cut, gain, value = found.pop(k)
        assert value.tolist() == rule.value(total) and ((f, cut, gain) == split if split else f == -1)
        if split:
            right = x[rows, f] > cut
            walk(2 * k, rows[~right])
            walk(2 * k + 1, rows[right])

    walk(1, np.arange(900))
    assert not found


def test_features_counted_together_have_their_own_sums():
    """Features of few bins share a pass over the rows; nodes, cuts and sums are those of features counted one by one."""
    rng = np.random.default_rng(7)
    sizes = (127, 2, 24, 2, 100, 3, 1, 7)
    x = np.stack([rng.integers(0, n, 50_000) for n in sizes], axis=1).astype(np.uint8)
    values = np.stack([rng.integers(-H.UNIT, H.UNIT, 50_000), rng.integers(1, H.UNIT // 4, 50_000)], axis=1).astype(np.int32)
    one, together = H.Boosting(0.1, 20, 8), H.Boosting(0.1, 20, 8, sizes=sizes)
    assert len(together.joined(8, 128)) < len(one.joined(8, 128)) == 8
    slot = np.arange(50_000) % 3
    assert np.array_equal(one.histograms(x, values, slot, 3, 128), together.histograms(x, values, slot, 3, 128))
    assert list(one.grown(x, values, 0, 1, 128, 31)) == list(together.grown(x, values, 0, 1, 128, 31))


def _random_tree(rng, leaves, width, outputs):
    feature, cut, left, ends = [-1], [0.0], [0], [0]
    while len(ends) < leaves:
        at = ends.pop(int(rng.integers(len(ends))))
        feature[at], cut[at], left[at] = int(rng.integers(width)), float(rng.integers(-20, 20)) / 10, len(feature)
        ends += [len(feature), len(feature) + 1]
        feature, cut, left = feature + [-1, -1], cut + [0.0, 0.0], left + [0, 0]
    return H.Tree(np.array(feature, np.int32), np.array(cut), np.array(left, np.int32), rng.random((len(feature), outputs)))


@pytest.mark.parametrize("leaves", [1, 2, 31, 40, 64, 65, 900])
def test_scores_are_the_leaves_values(leaves):
    """Lookups and steps find the leaf that a walk down the tree finds, with values on a cut, beyond all cuts and missing."""
    rng = np.random.default_rng(leaves)
    x = np.round(rng.normal(size=(2000, 6)), 1)
    x[rng.random(x.shape) < 0.05] = np.nan
    x[0], x[1] = np.inf, -np.inf
    trees = [_random_tree(rng, leaves, 6, 4) for _ in range(3)]
    places = H.TreeEnsemble(list("abcdef"), trees).on_places()
    assert all((len(t) == 2) == (leaves <= 64) for t in places.trees)
    want = sum(t.value[t.leaves(x)] for t in trees)
    assert np.array_equal(places.probabilities(list(x.T)), want / want.sum(axis=1, keepdims=True))


def test_trees_that_begin_alike_share_their_rows(spark, decided, monkeypatch):
    """The rows go to a task once for all of its trees, not once for each tree."""
    whole = []
    monkeypatch.setattr(H, "_dealt", lambda *a: whole.append(a))  # only nodes below the roots are dealt one by one
    model = L.randomised_forest(decided[0], features=USE, trees=20, depth=5)
    assert not whole and len(model.trees) == 20


def test_nodes_are_dealt_by_their_rows():
    sizes = {(0, 1): 100, (1, 1): 60, (2, 1): 50, (3, 1): 40, (4, 1): 40}
    places = H._dealt(sizes, 3)
    filled = [sum(n for k, n in sizes.items() if places[k] == i) for i in range(3)]
    assert set(places) == set(sizes) and sum(filled) == 290 and max(filled) <= 100


def test_boosted_rows_travel_and_add_up_by_combinations_of_bins():
    rng = np.random.default_rng(5)
    sizes, n = (100, 40, 7, 2, 2, 12), 9_000
    x = np.stack([rng.integers(0, b, n) for b in sizes], axis=1).astype(np.uint8)
    values = np.stack([rng.integers(-H.UNIT, H.UNIT, n) + (x[:, 0] > 40) * np.int64(9_000_000) - x[:, 2] * x[:, 3] * np.int64(4_000_000), rng.integers(1, H.UNIT // 4, n)], axis=1).astype(np.int32)
    trees = []
    for depth, leaves in ((8, 31), (3, None), (7, None), (5, 9), (0, 31)):
        rule = H.Boosting(0.1, 20, depth, sizes=sizes)
        sent = rule.sent(x, 128)
        assert sent.shape[1] * sent.itemsize < 2 * len(sizes)  # features of few bins share a place
        rows = rule.received([sent[:5_000].tobytes(), sent[5_000:].tobytes()], len(sizes), 128)
        tree = H.assembled({k: rest for k, *rest in rule.grown_of_sent(rows, values, 0, 1, 128, leaves, len(sizes))}, (), leaves)
        at, sums = tree.leaves(x), np.zeros((len(tree.feature), 2), np.int64)
        np.add.at(sums, at, values)
        for leaf in np.unique(at):  # each leaf has the value of the rows that walk to it
            assert tree.value[leaf].tolist() == rule.value(sums[leaf])
        trees.append(tree)
    assert max((t.feature < 0).sum() for t in trees) > 32  # one that isn't looked up
    begin = rng.normal(size=(n, len(trees)))
    ready = H.lookups_of_round(trees, rule, len(sizes), 128)
    one, two = (m.copy() for m in H._added(begin, x, rule.coded(x, 128), [ready, ready], 0.08))
    walked = np.stack([0.08 * t.value[t.leaves(x)][:, 0] for t in trees], axis=1)
    assert (one == begin + walked).all() and (two == begin + walked + walked).all()
