"""The ten operators against brute force and on awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from roadpulse.llm import catalog as C
from roadpulse.llm import decontamination, grams, language_id, mixing, neighbours, repeats, secret_scan, simhash_dedup
from roadpulse.llm import substring_dedup, suffix_dedup, token_counts, toxicity
from roadpulse.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, start int, body string, n int, kept string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, lang, source, None if t is None else len(t), "x", 1, "y", 2, "z") for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(rng):
    base = words(rng, 300)
    text = " ".join(base)
    long = " ".join(words(rng, 30_000))
    return [
        (1, text, "en", "a"), (2, text, "en", "a"), (3, " ".join([*base[:150], "other", *base[151:]]), "de", None),
        (4, None, None, "b"), (5, "", "en", None), (6, " \t\n ", None, ""), (7, "one", "fr", "b"), (8, long, "en", "a"),
        (9, "lead " + " ".join(base[40:90]) + " tail", "de", "c"), (10, "a" * 1500, "en", "c"), (11, "é日𝕏 " * 200, "es", "c"),
        (11, "é日𝕏 " * 200, "es", "c"), (12, text + "\n" + text, "en", "a"), (None, text, "en", "a"), (13, "\x0b\x0c" + text + "\x1c x", "en", "a"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, awkward(random.Random(1)))


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, []), awkward(random.Random(1))


# --- repeated windows ---------------------------------------------------------------------------------------


def brute_words(rows):
    first, out = {}, []
    tokens = [(i, WORD.findall((t or "").encode())) for i, t, *_ in rows]
    for i, w in tokens:
        for s in range(len(w) - 19 if i is not None else 0):
            key = tuple(w[s: s + 20])
            first[key] = min(first.get(key, (i, s)), (i, s))
    for i, w in tokens:
        gone = [False] * len(w)
        for s in range(len(w) - 19 if i is not None else 0):
            if first[tuple(w[s: s + 20])] < (i, s):
                gone[s: s + 20] = [True] * 20
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(rows):
    count, out = {}, []
    for i, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - 399 if i is not None else 0):
            count[b[s: s + 400]] = count.get(b[s: s + 400], 0) + 1
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 399 if i is not None else 0):
            if count[b[s: s + 400]] > 1:
                gone[s: s + 400] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(docs):
    got = sorted(map(tuple, substring_dedup.deduplicate(docs).collect()), key=repr)
    assert got == brute_words(awkward(random.Random(1)))


def test_suffix_dedup(docs):
    got = sorted(map(tuple, suffix_dedup.deduplicate(docs).collect()), key=repr)
    want = brute_bytes([r for r in awkward(random.Random(1)) if r[0] != 8] + [r for r in awkward(random.Random(1)) if r[0] == 8])
    assert got == want


@pytest.mark.parametrize("length, gram", [(20, 4), (400, 16), (21, 4), (5, 5), (6, 5)])
def test_halves_hold_each_window_once_and_what_it_shares(length, gram):
    rng = np.random.default_rng(length)
    for n in (length, length + 1, 3 * length, 1500):
        hashes = rng.integers(0, 40, n - gram + 1).astype(np.uint64) << np.uint64(24)
        seen = []
        for first, last, at in repeats.regions(hashes, length, gram):
            for s0, s1, a, b in repeats.halves(first, last, at, length, gram):
                seen.extend(range(s0, s1 + 1))
                assert all(w <= a and b <= w + length for w in range(s0, s1 + 1)) and b - a > (length - gram) // 2
        assert sorted(seen) == list(range(n - length + 1))


def test_frequent_gram_in_different_surroundings(spark):
    """One line in every document, shorter than a window, beside copies: only the copies repeat."""
    rng = random.Random(6)
    rows = [(i, " ".join([*words(rng, 40, 10**6), *["same"] * 11, *words(rng, 40, 10**6)]), "en", "a") for i in range(80)]
    rows += [(100 + i, t, "en", "a") for i, (_, t, *_) in enumerate(rows[:20])]
    df = table(spark, rows)
    assert sorted(map(tuple, substring_dedup.deduplicate(df).collect()), key=repr) == brute_words(rows)
    assert sorted(map(tuple, suffix_dedup.deduplicate(df).collect()), key=repr) == brute_bytes(rows)


def test_hot_passage_is_split(spark, monkeypatch):
    """A passage in every document, with other words around it, in parts of a few regions."""
    monkeypatch.setattr(repeats, "PART_ROWS", 4)
    monkeypatch.setattr(repeats, "BLOCK_TOKENS", 256)
    rng = random.Random(2)
    passage = words(rng, 90)
    rows = [(i, " ".join([*words(rng, 60, 10**6), *passage[i % 7:], *words(rng, 60, 10**6)]), "en", "a") for i in range(60)]
    df = table(spark, rows)
    assert sorted(map(tuple, substring_dedup.deduplicate(df).collect()), key=repr) == brute_words(rows)
    assert sorted(map(tuple, suffix_dedup.deduplicate(df).collect()), key=repr) == brute_bytes(rows)


def test_kept_texts(docs):
    kept = {r.doc_id: r for r in suffix_dedup.deduplicate(docs, kept_bytes=True).collect()}
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept.values())
    assert kept[2].kept == b"" and kept[7].kept == b"one"


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(500):
        text = [rng.randrange(rng.choice((1, 2, 3, 9))) for _ in range(rng.randrange(0, 60))] + [-1]
        assert suffix_dedup.grouped_suffixes(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_fm_index():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 6, 400), 0)  # the last symbol is the smallest
    index = substring_dedup.FMIndex(text)
    for _ in range(100):
        a = int(rng.integers(0, 390))
        pattern = text[a: a + int(rng.integers(1, 10))]
        low, high = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        want = [i for i in range(len(text) - len(pattern) + 1) if (text[i: i + len(pattern)] == pattern).all()]
        assert sorted(index.order[low[0]: high[0]].tolist()) == want


# --- near duplicates ----------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = WORD.findall((text or "").encode().lower())
    if not w:
        return 0
    shingles = [b" ".join(w[i: i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    root = {i: i for i in values}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in values:
        for j in values:
            if i < j and bin(values[i] ^ values[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in values}


def test_simhash(spark):
    rng = random.Random(5)
    rows = [r for r in awkward(rng) if r[0] is not None and r[0] != 8]
    for i in range(100, 160):  # chains of small edits
        w = words(rng, 400) if i % 12 == 4 else w  # noqa: F821
        w = [*w]
        w[rng.randrange(len(w))] = "X"
        rows.append((i, " ".join(w).upper() if i % 2 else " ".join(w), "en", "a"))
    values = {i: brute_fingerprint(t) for i, t, *_ in rows}
    got = simhash_dedup.components(table(spark, rows)).select("doc_id", simhash_dedup.hexadecimal(F.col("fp")).alias("f"), "component_id").collect()
    assert len(got) == len(rows)
    assert all(int(r.f, 16) == values[r.doc_id] and len(r.f) == 16 for r in got)
    want = brute_components(values)
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want)


def test_links_of_other_radii(spark):
    rng = random.Random(6)
    values = [rng.getrandbits(64)]
    for _ in range(80):
        values.append(rng.choice(values) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 4))))
    signed = [v - (1 << 64) if v >> 63 else v for v in set(values)]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for radius in (1, 2, 3):
        pairs = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
        found = {tuple(sorted(r)) for r in simhash_dedup.links(df, radius).select("a", "b").collect()}
        assert found <= pairs
        if radius % 2:
            assert found == pairs


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    by_root = {}
    for r in connected_components(edges).collect():
        by_root.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, by_root.values())) == [2, 301]


# --- tokens -------------------------------------------------------------------------------------------------


def test_prefix_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, counter = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PrefixCounter(path)
    rng = random.Random(7)
    for _ in range(400):
        text = "".join(rng.choice("ab the ingé日𝕏  \n\t<s>▁.0129") for _ in range(rng.randrange(40)))
        counts = counter.every_prefix(text)
        assert len(counts) == len(text)
        for j in range(1, len(text) + 1):
            assert counts[j - 1] == len(model.encode(text[:j]))
    rows = awkward(rng)
    got = token_counts.count_tokens(table(spark, rows), path).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(
        ((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t, *_ in rows), key=key
    )
    cut = token_counts.truncate_texts(table(spark, rows), path, 50).select("doc_id", "text").collect()
    for (i, t, *_), r in zip(sorted(rows, key=key), sorted(cut, key=key)):
        if t is None:
            assert r.text is None
        else:
            assert t.startswith(r.text) and len(model.encode(r.text)) <= 50
            assert r.text == t or max(len(model.encode(t[:k])) for k in range(len(r.text) + 1, len(r.text) + 2)) > 50


# --- mixing -------------------------------------------------------------------------------------------------


def test_targets():
    goals = mixing.targets([("b", 100), ("a", 100), (None, 100), ("c", 10)])
    assert [s for s, _, _ in goals] == ["a", "b", "c", None]
    assert abs(sum(t for *_, t in goals) - 465) < 1e-9
    assert all(t <= 2 * n + 1e-9 for _, n, t in goals)
    assert mixing.targets([]) == []
    assert mixing.targets([("a", 0), ("b", 8)])[1][2] == 12.0


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 40))), "en", rng.choice(["a", "a", "a", "b", "", None])) for i in range(500)]
    rows += [(7, "same row", "en", "a")] * 3 + [(900, None, "en", None)]
    first, again = (sorted(map(tuple, mixing.mix(table(spark, rows)).collect()), key=repr) for _ in range(2))
    assert first == again and len(first) == len(rows)
    by = {}
    for _, source, size, source_size, target, taken in first:
        assert 0 <= taken <= 2 * size
        s = by.setdefault(source, [0, 0, source_size, target])
        s[0] += size
        s[1] += taken
    for size, taken, source_size, target in by.values():
        assert size == source_size and abs(taken - target) <= 1
    assert {r[2] for r in first if r[0] == 900} == {0}


def test_mix_order(spark):
    rows = [(i, "w " * 10, "en", "ab"[i % 2]) for i in range(100)]
    goals = mixing.targets([("a", 500), ("b", 500)], weights=(3, 1), share=0.5)
    frame = spark.createDataFrame(goals, "source string, source_size long, target double")
    sized = mixing.sizes(table(spark, rows))
    mixed = mixing.truncated(mixing.readings(sized, frame), goals, 500.0).orderBy("position").collect()
    assert [r.position for r in mixed] == list(np.cumsum([0] + [r.taken for r in mixed])[:-1])
    a = [sum(r.taken for r in mixed[:k] if r.source == "a") / sum(r.taken for r in mixed[:k]) for k in (12, 24, 36, len(mixed))]
    assert all(abs(x - 0.75) < 0.1 for x in a)


# --- neighbours ---------------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1500, 24))
    x[200:700] = x[3]  # a third of copies
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(5000, None, 0), (5001, [0.0] * 24, 0), (5002, [float("nan")] * 24, 0), (5003, [None] + [1.0] * 23, 0), (5004, [1.0, 2.0], 0), (5005, [2.0, 4.1], 0), (5006, [], 0), (5050, [float("inf")] * 24, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int")
    asked = df.where("vec_id % 50 = 0 OR vec_id = 5004")
    got = {}
    for r in neighbours.search(df, asked).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.pop(5004)[1][0] == 5005
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    hits = total = 0
    assert set(got) == {i for i in range(0, 1500, 50)}
    for q, found in got.items():
        cosine = unit @ unit[q]
        order = [i for i in np.lexsort((np.arange(1500), -np.round(cosine, 12))) if i != q][:5]
        assert sorted(found) == [1, 2, 3, 4, 5]
        assert all(abs(cosine[i] - s) < 1e-12 for i, s in found.values())
        if 200 <= q < 700 or q == 3:
            assert [found[k][0] for k in range(1, 6)] == order  # copies: ties to the smaller number
        hits += sum(cosine[i] >= cosine[order[-1]] - 1e-12 for i, _ in found.values())
        total += 5
    assert hits / total >= 0.9


def test_neighbours_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.search(df, df).count() == 0


# --- benchmark passages -------------------------------------------------------------------------------------


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontamination(spark):
    rng = random.Random(10)
    items = [(i, " ".join(words(rng, rng.randrange(12, 40), 5000)).capitalize() + ".") for i in range(12)] + [(50, None), (51, "Yes."), (52, "")]
    items.append((0, items[0][1]))
    rows = []
    for k in range(60):
        i, text = items[k % 12]
        edited = list(text)
        for _ in range(rng.randrange(0, len(text) // 12)):
            at = rng.randrange(len(edited))
            edited[at: at + 1] = rng.choice(["", "z", edited[at] + "q"])
        rows.append((k, " ".join(words(rng, 30, 5000)) + " \n" + "".join(edited) + "  " + " ".join(words(rng, 30, 5000)), "en", "a"))
    rows += [(100, None, "en", "a"), (101, "", "en", "a"), (102, "Yes.", "en", "a"), (103, " ".join(words(rng, 3000)), "en", "a"), (3, rows[3][1], "en", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: re.sub(r"[^a-z0-9]+", " ", (t or "").lower()).strip()
    usable = {(i, norm(t)) for i, t in items if len(norm(t)) >= 24}
    got = sorted((r.doc_id, sorted(set(r["items"]))) for r in decontamination.matches(table(spark, rows), bench).collect())
    want = []
    for d, t, *_ in rows:
        near = []
        for i, item in usable:
            k = min(int(0.05 * len(item)), (len(item) - 8) // 8)
            if d != 103 and distance(item, norm(t)) <= k:
                near.append(i)
        want.append((d, sorted(near)))
    assert got == sorted(want)
    assert 20 < sum(bool(n) for _, n in want) < 60
    blocks = decontamination.matches(table(spark, rows[:20]), bench, block_bytes=300).collect()
    assert sorted((r.doc_id, sorted(set(r["items"]))) for r in blocks) == sorted(want[:20])


# --- learnt operators ---------------------------------------------------------------------------------------


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").withColumn("f", language_id.fold(F.col("doc_id"), 4))
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 4 for r in df.collect())


def syllables(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


LANGUAGES = {"aa": ["ka", "to", "mi", "ne"], "bb": ["ru", "sol", "ven", "dé"], "cc": ["qu", "ix", "zo", "pa"]}


def test_language_id(spark):
    rng = random.Random(11)
    rows = [(i, syllables(rng, LANGUAGES[g], rng.randrange(3, 80)), g, "s") for i in range(300) for g in [rng.choice("aa bb cc".split())]]
    rows += [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "123 !? 4", "bb", "s"), (1003, syllables(rng, LANGUAGES["aa"], 30_000).upper(), None, "s"), (1003, "x", None, "s")]
    df = table(spark, rows)
    model = language_id.train(df.where(language_id.fold(F.col("doc_id"), 4) != 2))
    got = language_id.predict(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    true = {i: g for i, _, g, _ in rows}
    held = [r for r in got if r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang_pred == true[r.doc_id] for r in held]) > 0.97
    odd = {(r.doc_id, r.lang_pred) for r in got if r.doc_id >= 1000}
    assert {(1000, "und"), (1001, "und"), (1002, "und"), (1003, "aa")} <= odd


def test_language_filter_has_all_kept_grams(spark):
    rng = random.Random(12)
    df = table(spark, [(i, syllables(rng, LANGUAGES[g], 50), g, "s") for i, g in enumerate("aa bb cc".split() * 5)])
    model = language_id.train(df)
    for r in language_id.kept_grams(language_id.gram_counts(df)).collect():
        mask = model.masks(np.array([r.gram], np.int64).view(np.uint64))[0]
        assert int(mask) >> model.languages.index(r.lang) & 1


def test_gram_keys():
    keys, rows = grams.gram_keys(pa.array(["Ab  cd", "", "É9"]), 3)
    show = [(int(r), int(k).to_bytes(8, "big").lstrip(b"\0")) for k, r in zip(keys, rows)]
    assert show == [
        (0, b"\1a"), (0, b"\1ab"), (0, b"ab\1"), (0, b"\1c"), (0, b"\1cd"), (0, b"cd\1"), (2, b"\1\xc3"), (2, b"\1\xc3\xa9"), (2, b"\xc3\xa9\1"),
    ]


def test_toxicity(spark):
    rng = random.Random(13)
    bad = ["zark", "grolt", "blix"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = syllables(rng, LANGUAGES["aa"], rng.randrange(20, 120)).split()
        for _ in range(len(w) // 12 + 1 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "aa", "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, None, None), (901, "", None, None), (902, "12 34", None, None), (903, syllables(rng, LANGUAGES["bb"], 20_000), None, None)]
    labels += [(901, 1, 0), (900, None, None), (5, 1, 1)]
    df = table(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df, known.where(language_id.fold(F.col("doc_id"), 3) != 1)).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    toxic, plain = [got[i] for i in held if i % 5 == 0], [got[i] for i in held if i % 5]
    assert np.mean([t > p for t in toxic for p in plain]) > 0.97
    assert np.mean(np.array(toxic) >= 0.7) > 0.8 and np.mean(np.array(plain) >= 0.7) < 0.05
    none = toxicity.score_toxicity(df, known.where("false")).collect()
    assert len(none) == len(rows) and all(r.score == 0 for r in none)


def test_shared_backoff_sums_to_one(spark):
    """Over all characters that can follow a history, each class gives probability one or less."""
    rng = random.Random(14)
    df = spark.createDataFrame([(syllables(rng, LANGUAGES["aa"], 40), i % 2) for i in range(10)], "text string, toxic int")
    seen, _ = toxicity.log_ratios(toxicity.gram_counts(df, 3), 3)
    rows = seen.collect()
    assert rows and all(np.isfinite(r.ratio) for r in rows)


def test_secret_scan(spark):
    rng = random.Random(15)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, true = [], set()
    for i in range(240):
        w = syllables(rng, LANGUAGES["aa"], 40).split()
        kind = i % 6
        if kind == 0:
            s = "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(15)) + "7"
            w.insert(20, s)
            true.add((i, s))
        elif kind == 1:
            s = hexa(39) + "7"
            w.insert(20, f'token = "{s}"')
            true.add((i, s))
        elif kind == 2:
            w.insert(20, "4" + "".join(rng.choice("0123456789") for _ in range(15)))
        elif kind == 3:
            s = hexa(17) + "7"
            w.insert(20, f"password={s}")
            true.add((i, s))
        rows.append((i, " ".join(w), "aa", rng.choice(["src/a.py", "tests/x", None])))
    rows += [(900, None, None, None), (901, "", None, None), (902, " ".join(["x1" * 30] * 5000), None, "p"), (1, rows[1][1], "aa", None)]
    df = table(spark, rows)
    got = secret_scan.scan(df).collect()
    found = {(r.doc_id, r.candidate) for r in got if r.is_secret}
    assert true <= found
    assert not {i for i, _ in found if i < 900 and i % 6 in (2, 4, 5)}
    assert {r.doc_id: r.n for r in got}.get(902) == 5000
    clean = {r.doc_id: r.text for r in secret_scan.redacted(df, spark.createDataFrame(sorted(true), "doc_id long, candidate string")).collect()}
    assert len(clean) == len(rows) - 1 and all(s not in clean[i] for i, s in true)
    assert clean[2] == rows[2][1] and clean[900] is None


# --- empty tables and registered queries ----------------------------------------------------------------------


def test_empty_tables(spark):
    df = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    import public_tokenizers

    assert substring_dedup.deduplicate(df).count() == 0
    assert suffix_dedup.deduplicate(df).count() == 0
    assert simhash_dedup.components(df).count() == 0
    assert mixing.mix(df).count() == 0
    assert language_id.predict(df, language_id.train(df)).count() == 0
    assert toxicity.score_toxicity(df, labels).count() == 0
    assert secret_scan.scan(df).count() == 0
    assert decontamination.matches(df, bench).count() == 0
    assert decontamination.matches(table(spark, awkward(random.Random(1))), bench).where("size(items) > 0").count() == 0
    assert token_counts.count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_registered(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op4_simhash", "op7_mixing", "op8_language_id", "op9_decontamination", "op10_token_counts"):
        assert C.QUERIES[name](spark, sf_dir).count() == n
    assert sorted(int(q[2:].split("_")[0]) for q in C.QUERIES) == list(range(1, 14))


def test_decontamination_in_blocks_keeps_each_row(spark):
    rng = random.Random(34)
    items = [(i, " ".join(words(rng, 12, 10**6))) for i in range(6)]
    items.append(items[1])
    texts = [f"{items[0][1]} more {items[1][1]}", f"x {items[2][1]}", items[3][1], "no item here at all"]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, None), (2, texts[3])]
    docs = table(spark, [(i, t, "en", "a") for i, t in rows])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(1, [0, 1, 1]), (1, [0, 1, 1]), (1, [2]), (None, [3]), (None, []), (None, []), (2, [])]
    for block_bytes in (1 << 20, 200):
        got = [(r.doc_id, r["items"]) for r in decontamination.matches(docs, bench, block_bytes=block_bytes).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_decontamination_of_repetitive_texts(spark):
    """Periods of one, two and three bytes, alone and inside other text, against the edit distance to every part."""
    rng = random.Random(35)
    base = [("a" * 60, 0), ("ab" * 30, 1), ("abc" * 25, 2), ("a" * 30 + "q" + "a" * 30, 3), ("a" * 40 + " ".join(words(rng, 5, 50)), 4)]
    texts = ["a" * n for n in (10, 57, 60, 61, 500)] + ["ab" * n for n in (20, 29, 30, 200)] + ["abc" * n for n in (23, 25, 90)]
    texts += ["a" * 29 + "q" + "a" * 31, "a" * 29 + "qq" + "a" * 31 + "b" * 50 + "a" * 58, "ba" * 40 + "a" * 57 + "abc" * 24, "a" * 40 + base[4][0], "zz" + base[4][0][2:]]
    column = pa.array([*texts, None, ""])
    index = decontamination.prepare([(i, t) for t, i in base])
    want = [sorted(i for t, i in base if distance(t, x) <= min(int(0.05 * len(t)), (len(t) - 8) // 8)) for x in texts]
    old = decontamination.PAIRS
    try:
        for pairs in (old, 7):
            decontamination.PAIRS = pairs
            assert decontamination.contained(column, index) == [*want, [], []]
    finally:
        decontamination.PAIRS = old
    assert sum(map(len, want)) > 10


def test_decontamination_of_a_long_run_in_bounded_memory():
    import tracemalloc

    index = decontamination.prepare([(1, "a" * 1000), (2, "b" * 500 + "a" * 500)])
    column = pa.array(["a" * 1_000_000, "ab" * 20_000])
    tracemalloc.start()
    assert decontamination.contained(column, index) == [[1], []]
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_rows_are_filtered_one_by_one(spark):
    """Null and repeated doc_id in the filters of the pipeline."""
    rng = random.Random(36)
    text = lambda n: syllables(rng, LANGUAGES["aa"], n)
    item, other = text(40), text(60)
    rows = [(1, other, "aa", "a"), (1, f"x {item}", "aa", "a"), (None, item, "aa", "a"), (None, text(50), "aa", "a"), (None, None, None, None), (2, other, "aa", "b")]
    rows += [(3, text(50), "aa", "a")] * 3
    docs = table(spark, rows)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontamination.without_items(docs, bench)
    assert left.columns == docs.columns
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if item not in (r.text or ""))
    known = language_id.in_known_language(docs, language_id.train(docs))
    assert sorted(map(str, known.collect())) == sorted(str(r) for r in docs.collect() if r.text)
    one = simhash_dedup.one_of_each(docs).collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in one), key=str) == sorted(
        {(1, other, "a"), (1, rows[1][1], "a"), *[(r[0], r[1], r[3]) for r in rows[2:5]], (3, rows[6][1], "a")}, key=str)


def test_one_of_each_keeps_the_smallest_of_every_component(spark):
    rng = random.Random(37)
    texts = [" ".join(words(rng, 80, 3000)) for _ in range(20)]
    rows = [(100 - i, texts[i % 20] + (" " + "x" * (i // 60) if i >= 60 else ""), "en", "a") for i in range(90)] + [(None, texts[0], "en", "a"), (None, "", "en", "b")]
    docs = table(spark, rows)
    want = {r.component_id for r in simhash_dedup.components(docs.where("doc_id IS NOT NULL")).collect()}
    got = [r.doc_id for r in simhash_dedup.one_of_each(docs).collect()]
    assert sorted(i for i in got if i is not None) == sorted(want) and got.count(None) == 1
    assert simhash_dedup.one_of_each(docs.limit(0)).count() == 0


def test_secrets_of_rows_without_doc_id(spark):
    rng = random.Random(38)
    make = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(15)) + "7"
    numbers = lambda: "4" + "".join(rng.choice("0123456789") for _ in range(15))
    body = lambda s: f'{syllables(rng, LANGUAGES["aa"], 20)} {s} {syllables(rng, LANGUAGES["aa"], 5)}'
    held = [make() for _ in range(20)]
    rows = [(None if i < 10 else 5, body(s), "aa", "p") for i, s in enumerate(held)] + [(100 + i, body(numbers()), "aa", None) for i in range(20)]
    rows += [(None, body(numbers()), "aa", None), (None, None, None, None), (5, body("no secret"), "aa", "p")] + [rows[0]]
    docs = table(spark, rows)
    found = secret_scan.scan(docs)
    assert {r.candidate for r in found.where("is_secret = 1").collect()} == set(held)
    clean = secret_scan.redacted(docs, found.where("is_secret = 1")).collect()
    assert len(clean) == len(rows) and not any(s in (r.text or "") for r in clean for s in held)
    assert sum("[secret]" in (r.text or "") for r in clean) == 21
