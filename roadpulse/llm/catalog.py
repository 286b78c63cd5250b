"""Registered queries opN_<name>; none of them has SQL but where SQL can state the whole result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm import decontamination, language_id, lexical_search, mixing, neighbours, ngram_join, secret_scan
from roadpulse.llm import simhash_dedup, substring_dedup, suffix_dedup, token_counts, toxicity, whitening
from roadpulse.llm.frames import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents with the forest's verdict."""
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("row_key")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(language_id.fold(F.col("doc_id"), 3) != 1)
    scored = toxicity.score_toxicity(docs, labels)
    return scored.select(
        "doc_id", (language_id.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "log_ratio",
    )


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of each vector whose number 50 divides, among all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where("vec_id % 50 = 0"), near=5)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash_dedup.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without word windows that start earlier somewhere."""
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings that start anywhere else."""
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of one and a half times all words takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(language_id.fold(F.col("doc_id"), 4) != 2))
    found = language_id.predict(docs, model)
    return found.select("doc_id", (language_id.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document contains."""
    found = decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("leaked"), F.col("items"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the 32k piece vocabulary."""
    import public_tokenizers

    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under links of 85 % of the words' 4-grams."""
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f for f in (
        op1_secret_scan, op2_toxicity, op3_neighbours, op4_simhash, op5_substring_dedup, op6_suffix_dedup, op7_mixing,
        op8_language_id, op9_decontamination, op10_token_counts, op11_whitening, op12_ngram_join, op13_lexical_search,
    )
}
_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[0-9A-Za-z\x{80}-\x{10FFFF}]+')"""

ORACLE: dict[str, str] = {
    "op12_ngram_join": r"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM doc),
run AS (SELECT r, i, t, lead(t, 1) OVER o AS t2, lead(t, 2) OVER o AS t3, lead(t, 3) OVER o AS t4 FROM word WINDOW o AS (PARTITION BY r ORDER BY i)),
single AS (SELECT DISTINCT r, concat_ws(' ', t, t2, t3, t4) AS g FROM run WHERE i = 1 OR t4 IS NOT NULL),
sized AS (SELECT r, doc_id, coalesce(n, 0) AS n FROM doc LEFT JOIN (SELECT r, count(*) AS n FROM single GROUP BY 1) USING (r)),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM single a JOIN single b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
edge AS (SELECT a, b FROM common JOIN sized x ON x.r = a JOIN sized y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT r, r AS s FROM doc UNION SELECT reach.r, edge.b FROM reach JOIN edge ON edge.a = reach.s)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN sized d ON d.r = reach.r JOIN sized o ON o.r = reach.s GROUP BY d.r, d.doc_id, d.n""",
    "op13_lexical_search": f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
size AS (SELECT r, doc_id, len(ts) AS n FROM doc WHERE len(ts) > 0),
whole AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM size),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM doc) GROUP BY 1, 2),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY t, nd),
impact AS (SELECT tf.r, tf.t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))) AS i
  FROM tf JOIN size USING (r) JOIN w USING (t), whole),
asked AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE text IS NOT NULL) GROUP BY 1, 2),
scored AS (SELECT item_id, r, CAST(sum(k * i) AS BIGINT) AS score FROM asked JOIN impact USING (t) GROUP BY 1, 2),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored JOIN size USING (r) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20""",
}
