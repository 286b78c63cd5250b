"""Quantiles by selection against sorted lists."""

import math
import random

import pytest

from roadpulse.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.25, 0.5, 0.9, 1.0]


def sorted_quantile(values, share):
    place = share * (len(values) - 1)
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high


@pytest.mark.parametrize("kind, draw", [
    ("double", lambda r: r.gauss(0, 1)), ("double", lambda r: r.uniform(7, 7.000001)), ("double", lambda r: r.choice([0.0, -0.0, 1e-310, -1e300, 5.5, float("inf")])),
    ("float", lambda r: r.randrange(100) / 4), ("int", lambda r: r.randrange(-(2**31), 2**31)), ("int", lambda r: r.randrange(3)), ("bigint", lambda r: r.randrange(10**6)),
])
def test_equals_sorted_values(spark, kind, draw):
    rng = random.Random(kind)
    rows = [(rng.choice(["a", "a", "a", "b", None]), draw(rng)) for _ in range(501)] + [("c", None), ("d", draw(rng)), ("a", None)]
    df = spark.createDataFrame(rows, f"g string, v {kind}")
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    found = {r["g"]: r["quantiles"] for r in exact_quantiles(df, "v", SHARES, ["g"]).collect()}
    assert found.keys() == want.keys()
    for g, values in want.items():
        assert found[g] == [sorted_quantile(sorted(values), s) for s in SHARES]
    every = exact_quantiles(df, "v", SHARES).first()["quantiles"]
    assert every == [sorted_quantile(sorted(v for _, v in rows if v is not None), s) for s in SHARES]


def test_many_distinct_doubles_in_one_group(spark):
    """Continuous values that share their leading bits: the passes narrow them, and no plan gathers them."""
    df = spark.range(200_000).selectExpr("1 + pmod(xxhash64(id), 1000000007) / 1e15 AS v")
    found = exact_quantiles(df, "v", [0.5, 0.999])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_set" not in plan
    values = sorted(r.v for r in df.collect())
    assert found.first()[0] == [sorted_quantile(values, s) for s in (0.5, 0.999)]


def test_tables_without_values(spark):
    none = spark.createDataFrame([("a", None)], "g string, v double")
    assert exact_quantiles(none, "v", [0.5], ["g"]).count() == 0
    assert [r["quantiles"] for r in exact_quantiles(none, "v", [0.5, 1.0]).collect()] == [[None, None]]
