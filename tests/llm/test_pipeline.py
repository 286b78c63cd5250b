"""The stages of the corpus pipeline on awkward documents."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_operators import LANGUAGES, syllables


def documents(spark):
    rng = random.Random(20)
    text = lambda n: syllables(rng, LANGUAGES["aa"], n)
    item = text(40)
    rows = [(i, text(rng.randrange(40, 200)), "aa", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[5][1], "aa", "s0"), (101, rows[6][1], "aa", "s1")]  # copies
    rows += [(200 + i, f"{text(20)} {item} {text(20)}", "aa", "s1") for i in range(3)]
    rows += [(300 + i, f"{text(30)} AKIA{rng.randrange(10**15, 10**16)} {text(5)}", "aa", "s2") for i in range(4)]
    rows += [(310 + i, f"{text(30)} 4{rng.randrange(10**14, 10**15)} {text(5)}", "aa", "s2") for i in range(4)]
    rows += [(400, None, "aa", "s0"), (401, "", None, None), (402, "!! 12", None, "s1")]
    full = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long"), item


def test_stages(spark, tmp_path):
    docs, item = documents(spark)
    sf = str(tmp_path)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    gone = {"languages": {400, 401, 402}, "near_duplicates": {100, 101}, "benchmark_passages": {200, 201, 202}}
    for name, stage in P.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        after = stage(spark, docs, sf)
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        if name != "source_mix":
            assert after.dtypes == docs.dtypes
            assert before - kept == gone.get(name, set())
        if name == "secrets":
            texts = {r.doc_id: r for r in after.collect()}
            assert all("AKIA" not in texts[i].text and "[secret]" in texts[i].text for i in range(300, 304))
            assert all("[secret]" not in texts[i].text for i in range(310, 314))
            assert all(r.n_chars == len(r.text) for r in texts.values())
        docs = after.sparkSession.createDataFrame(after.collect(), after.schema)
    result = P.run(spark, sf)
    assert {r.doc_id for r in result.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    by = result.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r.n - r.t) <= 1 for r in by)


def test_empty(spark, tmp_path):
    docs, _ = documents(spark)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
