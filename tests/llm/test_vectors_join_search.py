"""Whitening, the n-gram join and the ranked search against brute force and on awkward tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import lexical_search, ngram_join, whitening
from roadpulse.llm.frames import stored
from tests.llm.test_operators import awkward, table, words


# --- whitening ----------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, x long, n string, d int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 5, "n", 1) for i, v in rows], VECTORS)


def brute_whitening(rows, most=4):
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * c) for c in v] for _, v in usable], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, components = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, components = values[::-1][:most], components[:, ::-1][:, :most]
    return [i for i, _ in usable], n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ components / np.sqrt(values), values


def test_whitening_equals_dense_algebra(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 7)) @ np.diag([3, 2, 1.5, 1, 0.4, 0.2, 0.1]) @ rng.standard_normal((7, 7))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(7, base[7].tolist())] * 50 + [(900, base[9].tolist()), (None, base[4].tolist())]
    rows += [(901, None), (902, [1, 2, None, 4, 5, 6, 7]), (903, [float("nan")] * 7), (904, [float("inf"), *[0.0] * 6])]
    found = whitening.whiten(vectors(spark, rows)).toPandas()
    ids, n, deviation, white, values = brute_whitening(rows)
    assert n == 400 and set(found["n"]) == {400} and len(found) == 4 * len(ids)
    assert sorted(found["vec_id"].fillna(-1)) == sorted([-1 if i is None else i for i in ids] * 4)
    one = {(i if i is not None else -1): k for k, i in enumerate(ids)}
    for k in range(4):
        own = found[found["component"] == k + 1]
        want = white[[one[int(i)] for i in own["vec_id"].fillna(-1)], k]
        assert min(np.abs(own["whitened"] - want).max(), np.abs(own["whitened"] + want).max()) < 1e-9
        assert own["deviation"].tolist() == deviation[[one[int(i)] for i in own["vec_id"].fillna(-1)]].tolist()
    assert found["identity_error"].max() < 1e-9
    shares = found.groupby("component")["explained"].first().to_numpy()
    total = np.trace(np.cov(np.unique(np.floor(256 * base), axis=0).T, bias=True))
    assert np.allclose(shares, values / total, rtol=1e-9)


def test_whitening_of_tables_without_enough_variance(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    same = whitening.whiten(vectors(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [])])).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in same) == [
        (i, k, 1, 0, None, None) for i in (1, 2) for k in (1, 2)]
    line = whitening.whiten(vectors(spark, [(1, [0, 0, 0]), (2, [1, 1, 1]), (3, [2, 2, 2])])).collect()
    assert {r["component"]: r["explained"] for r in line} == {1: 1.0, 2: 0.0, 3: 0.0}
    assert sorted(abs(r["whitened"]) for r in line if r["component"] == 1) == pytest.approx([0, 1.5**0.5, 1.5**0.5])
    assert all(r["whitened"] is None for r in line if r["component"] > 1)
    lengths = whitening.whiten(vectors(spark, [(1, [0, 1]), (2, [1, 0]), (3, [1.0]), (4, [2.0]), (5, [4.0])]))
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in lengths.collect()) == [(1, 1, 2), (1, 2, 2), (2, 1, 2), (2, 2, 2), (3, 1, 3), (4, 1, 3), (5, 1, 3)]


def test_whitening_of_equal_roots_and_of_huge_entries(spark):
    cross = [(i, [s if j == i % 3 else 0 for j in range(3)]) for i, s in [(0, 1), (1, 1), (2, 1), (3, -1), (4, -1), (5, -1)]]
    found = whitening.whiten(vectors(spark, cross), components=3).toPandas()
    assert np.allclose(found["explained"], 1 / 3) and found["identity_error"].max() < 1e-12
    huge = [(i, [1e300 if i else 0.0, float(i % 2), 2.0**50 * i]) for i in range(4)]
    found = whitening.whiten(vectors(spark, huge)).toPandas()
    assert found["deviation"].isna().all() and found["identity_error"].max() < 1e-6


def test_characteristic_polynomial_and_roots(spark):
    rng = random.Random(5)
    a = [[rng.randrange(-50, 50) for _ in range(6)] for _ in range(4)]
    m = [[sum(a[k][i] * a[k][j] for k in range(4)) for j in range(6)] for i in range(6)]  # rank 4
    polynomial = whitening.characteristic_polynomial(spark, m)
    assert polynomial[:2] == [0, 0] and polynomial[6] == 1 and polynomial[5] == -sum(m[i][i] for i in range(6))
    roots = whitening.largest_roots(polynomial, 6)
    want = np.linalg.eigvalsh(np.array(m, float))[::-1][:4]
    assert len(roots) == 4 and np.allclose([a / 2**s for a, s in roots], want, rtol=1e-9)
    # (x - 1) (x - 2)^2 (x - 3): a double root counts twice
    assert [round(a / 2**s, 12) for a, s in whitening.largest_roots([12, -28, 23, -8, 1], 4)] == [3, 2, 2, 1]
    with_limbs = np.array([[-(2**62), 5], [2**61 + 3, -7]])
    assert [[sum(int(p[i, j]) << (whitening.LIMB * k) for k, p in enumerate(whitening.limbs(with_limbs))) for j in range(2)] for i in range(2)] == with_limbs.tolist()


# --- n-gram join --------------------------------------------------------------------------------------------


def gram_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(b" ".join(w[i: i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute_join(rows):
    sets = [gram_set(t) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                group[root(i)] = root(j)
    low = {}
    for i, (name, *_) in enumerate(rows):
        if name is not None:
            low[root(i)] = min(low.get(root(i), name), name)
    return sorted([(name, len(sets[i]), low.get(root(i))) for i, (name, *_) in enumerate(rows)], key=repr)


def families(rng):
    """Groups of texts that share much, with similarities around the limit and long chains."""
    out, k = [], 1000
    for n in (4, 6, 9, 14, 25, 60, 200, 700):
        base = words(rng, n, 5000)
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randrange(0, 1 + n // 40 + (n > 8))):
                own[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            out.append((k, " ".join(own), "en", "f"))
            k += 1
    passage, base = words(rng, 60, 5000), words(rng, 150, 5000)
    for _ in range(30):  # a passage that unlike texts share
        out.append((k, " ".join([*words(rng, rng.randrange(3, 30), 5000), *passage]), "en", "f"))
        k += 1
    for i in range(25):  # a chain: only neighbours are alike
        out.append((k, " ".join(base[i * 2: i * 2 + 100]), "en", "f"))
        k += 1
    return out


def test_join_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [*awkward(rng), *families(rng), (None, "only here " * 9, "en", "a"), (None, "only here " * 9, "en", "a")]
    found = ngram_join.join_components(table(spark, rows)).collect()
    assert sorted([tuple(r) for r in found], key=repr) == brute_join(rows)


def near_copies(rng, copies, most=9):
    """Copies of one text with up to `most` words changed, of which few link; some changes are shared, some words are cut off."""
    base = words(rng, 150, 5000)
    common = [(rng.randrange(150), f"y{i}") for i in range(6)]
    out = []
    for k in range(copies):
        own = list(base)
        for _ in range(rng.randrange(most + 1)):
            place, word = rng.choice(common) if rng.random() < 0.3 else (rng.randrange(150), f"x{rng.randrange(10**9)}")
            own[place] = word
        out.append((5000 + k, " ".join(own[rng.choice([0, 0, 0, 1, 5]):]), "en", "n"))
    return out


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(85)
    rows = [*near_copies(rng, 120), *near_copies(rng, 40, 4), *families(rng)]
    found = ngram_join.join_components(table(spark, rows)).collect()
    assert sorted([tuple(r) for r in found], key=repr) == brute_join(rows)


def test_near_copies_that_do_not_link_are_not_paired(spark):
    """The sets at a segment make pairs with the square of the group; the pairs that are looked at grow with the group."""
    rng = random.Random(4)
    base = words(rng, 150, 5000)
    for copies in (40, 160):
        texts = [list(base) for _ in range(copies)]
        for own in texts:
            for place in rng.sample(range(150), 4):
                own[place] = f"x{rng.randrange(10**9)}"
        docs = table(spark, [(k, " ".join(own), "en", "n") for k, own in enumerate(texts)])
        held = ngram_join.repeated_only(ngram_join.signed(docs, 4, ngram_join.Classes(85)))
        held = stored(held.withColumn("node", F.monotonically_increasing_id()), "held")
        at_segments = ngram_join._met(held).groupBy("key").count().selectExpr("sum(count * (count - 1) / 2) AS pairs").first().pairs
        alone = held.selectExpr("node", "node AS root")
        deltas, rare = ngram_join.differences(docs, ngram_join.groups(held, alone), 4, 85)
        assert deltas.count() > 0.9 * copies and at_segments > copies * (copies - 1) / 2
        assert ngram_join.meetings(deltas, rare, ngram_join.rate(deltas), 85).count() < copies


def test_join_of_empty_tables(spark):
    assert ngram_join.join_components(table(spark, [])).count() == 0
    blank = ngram_join.join_components(table(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (2, " ", "en", "a")])).collect()
    assert sorted(tuple(r) for r in blank) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]


@pytest.mark.parametrize("n", [6, 7, 8, 12, 13, 20, 47, 120, 333, 2000])
def test_sets_that_link_meet_at_a_key(n):
    """Of many pairs at the limit of similarity, every one shares a key of the smaller set's class."""
    classes, rng = ngram_join.Classes(85), np.random.default_rng(n)
    for _ in range(200 if n < 500 else 20):
        m = n + int(rng.integers(0, 100 * n // 85 - n + 1))
        both = -(-85 * (n + m) // 185)
        if both > n:
            continue
        every = rng.integers(0, 2**64, n + m - both, np.uint64)
        one, other = np.sort(every[:n]), np.sort(every[n - both:])
        kind = classes.of(np.array([n]))
        assert classes.of(np.array([m]))[0] - kind[0] in (0, 1)
        keys = [set(ngram_join.segment_keys(s, np.array([len(s)]), kind, classes)[1].tolist()) for s in (one, other)]
        assert keys[0] & keys[1]
        assert np.bitwise_count((ngram_join.sketches(one, np.array([n])) ^ ngram_join.sketches(other, np.array([m]))).view(np.uint64)).sum() <= n + m - 2 * both


def test_sets_with_many_empty_segments_meet_at_a_later_cut():
    classes = ngram_join.Classes(85)
    close = np.arange(40, dtype=np.uint64)  # all in the first fragment of the first order
    other = np.concatenate([close[:-2], close[-2:] + np.uint64(100)])
    keys = [set(ngram_join.segment_keys(s, np.array([40]), classes.of(np.array([40])), classes)[1].tolist()) for s in (close, other)]
    assert len(keys[0]) > 1 and keys[0] & keys[1]


# --- ranked search ------------------------------------------------------------------------------------------


def brute_search(rows, items, near=20):
    term = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode().lower())
    docs = [(i, Counter(term(t))) for i, t, *_ in rows]
    n_docs, length = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for name, c in docs:
            m = 75 + 25 * c.total() * n_docs // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in term(text) if t in c)
            if s > 0:
                scored.append((-s, name is None, name or 0, s))
        out += [(item, r + 1, None if x[1] else x[2], x[3]) for r, x in enumerate(sorted(scored)[:near])]
    return sorted(out, key=repr)


ITEMS = "item_id long, text string, doc_id int, score double, place string"


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2.0, "p") for i, t in rows], ITEMS)


@pytest.mark.parametrize("shard", [50, 2_000_000])
def test_search_equals_brute_force(spark, shard):
    rng = random.Random(4)
    rows = [*awkward(rng), *[(100 + i, " ".join(f"w{min(int(rng.expovariate(0.02)), 399)}" for _ in range(rng.randrange(1, 90))), "en", "b") for i in range(250)]]
    rows += [(400 + i, "same same words W1 é日", "en", "b") for i in range(40)]
    items = [(i, " ".join(f"w{min(int(rng.expovariate(0.03)), 420)}" for _ in range(rng.randrange(1, 40)))) for i in range(25)]
    items += [(50, "same"), (50, "same"), (51, None), (52, ""), (53, "nowhere"), (54, "W1 w1 w1 é日 W1"), (None, "w3 w4")]
    found = lexical_search.search(table(spark, rows), benchmark(spark, items), shard_postings=shard, block_bytes=4 << 20 if shard > 50 else 200)
    assert sorted([tuple(r) for r in found.collect()], key=repr) == brute_search(rows, items)


def test_search_of_empty_tables(spark):
    some = benchmark(spark, [(1, "w1")])
    assert lexical_search.search(table(spark, []), some).count() == 0
    assert lexical_search.search(table(spark, awkward(random.Random(1))), benchmark(spark, [])).count() == 0


def test_pair_bounds_are_at_least_every_score_and_at_most_the_sum_of_maxima():
    rng = np.random.default_rng(2)
    terms, rows = np.repeat(np.arange(12), 60), np.concatenate([rng.choice(200, 60, replace=False) for _ in range(12)])
    shard = lexical_search.Shard(terms, rows, rng.integers(1, 1000, len(rows)), 200)
    asked = [(t, 1 + t % 3) for t in range(12)]
    shard.pair_tops(lexical_search.chosen_pairs(shard, asked))
    groups, single = shard.matched(asked), {x: shard.top[x[0]] * x[1] for x in asked}
    assert sorted(x for _, members in groups for x in members) == asked
    assert sum(b for b, _ in groups) < sum(single.values())
    for bound, members in groups:
        score = np.zeros(200, np.int64)
        for t, times in members:
            own, impacts = shard.list_of(t)
            score[own] += impacts * times
        assert score.max() <= bound <= sum(single[x] for x in members)
