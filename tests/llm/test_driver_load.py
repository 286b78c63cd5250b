"""What reaches the driver: no table for a join, filters only while they are used, few rounds of jobs."""

import random

from roadpulse.llm import components, frames, ngram_join


def _roots(spark, edges):
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    return {r["node"]: r["root"] for r in found}


def test_a_star_takes_few_rounds(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(components, "cut", lambda df: calls.append(1) or frames.cut(df))
    roots = _roots(spark, [(0, k) for k in range(1, 400)])
    assert set(roots) == set(range(400)) and len(set(roots.values())) == 1
    assert len(calls) <= 1 + 2 * 4  # two rounds


def test_components_of_any_shape(spark):
    names = random.Random(5).sample(range(10_000), 300)
    chain = list(zip(names[:120], names[1:121]))
    sorted_chain = [(20_000 + k, 20_001 + k) for k in range(100)]
    ring = [(names[200 + k], names[200 + (k + 1) % 50]) for k in range(50)]
    roots = _roots(spark, [*chain, *sorted_chain, *ring, ring[0], (7_000_000, 7_000_000)])
    parts = [names[:121], range(20_000, 20_101), names[200:250]]
    assert set(roots) == {k for part in parts for k in part}
    assert [len({roots[k] for k in part}) for part in parts] == [1, 1, 1] and len(set(roots.values())) == 3


def test_join_gathers_no_table_on_the_driver(spark, monkeypatch):
    plans, made = [], []

    def stored(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return frames.stored(df, name)

    asked = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: made.append(asked(self, value)) or made[-1])
    monkeypatch.setattr(ngram_join, "stored", stored)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    near = [" ".join([*base[:k], f"x{k}", *base[k + 1:]]) for k in range(0, 60, 3)]
    others = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(10)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*near, *others, others[0]])], "doc_id long, text string")
    out = ngram_join.join_components(docs)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    found = {r["doc_id"]: r["component_id"] for r in out.collect()}
    assert len(found) == 31 and found[30] == 20 and found[20] == 20 and found[21] == 21
    assert plans and not any("BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p for p in plans)
    assert made and all(b._jbroadcast is None or not b._jbroadcast.isValid() for b in made)
