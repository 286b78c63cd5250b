"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least 16 letters, digits and `_ + / -` with a digit in it, or whatever of at least
8 such signs follows a word like `password` or `token` and an assignment sign. Per document and distinct
candidate there is one finding, placed at its first occurrence, with the number of occurrences. Its features:

* length; parts of digits, upper case and signs; distinct characters; entropy; changes of character class;
* character transitions: mean log probability of its letter pairs in the frequent words of the corpus;
* dictionary coverage: part of its characters in runs of letters that are frequent words of the corpus;
* path: how many findings the path (or source) has per document, and whether it names tests or examples;
* neighbouring words: whether a key word, an assignment sign or a quotation mark stands before it, whether the
  words around it are frequent words, digits around it.

The forest learns from labelled findings (finding columns and `is_secret`). Where no labels are given,
`known_findings` marks those whose format settles the matter (key ids with a fixed prefix, keyed digests, card
and telephone numbers, plain numbers, long words); it learns from at most `most_labels` of them, chosen by hash.

Everything is DataFrame operations and the ML library; there is no Python on the executors. The dictionary has
at most 1 / least_share words. Null and empty texts have no finding; a null path is a path. Repeated rows count
as documents of their own but share findings; a text without doc_id, or with a repeated one, has its own findings.
An empty table has no finding. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.frames import cut

SIGN = r"[A-Za-z0-9_+/\-]"
KEYED = r"(?i:passw(?:or)?d|pwd|secret|token|api[_-]?key|auth)[\"']?\s?[:=]\s?[\"']?"
CANDIDATE = rf"(?<!{SIGN})(?:(?={SIGN}{{0,64}}[0-9]){SIGN}{{16,}}={{0,2}})|(?<={KEYED}){SIGN}{{8,}}={{0,2}}"
KEY_WORD = r"(?i)(passw(or)?d|pwd|secret|token|key|auth|credential)\W*$"
LEAST_SHARE = 1e-5
MOST_LABELS = 200_000
FEATURES = (
    "length", "digits", "upper", "signs", "distinct", "entropy", "changes", "transitions", "coverage", "path_rate", "path_test",
    "key_before", "assigned", "quoted", "known_before", "known_after", "digits_around",
)
ID = ("doc_id", "candidate")
KEY = "_finding"


def _row_key(doc_id, text):
    """What tells texts apart where doc_id is null or repeated: equal rows have equal findings."""
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(text).alias("text"))


def findings(docs: DataFrame, path: str = "source") -> DataFrame:
    """(row_key, doc_id, path, candidate, n, start, before, after) from rows (doc_id, text, path); of equal texts with one doc_id the first path counts."""
    part = docs.select("doc_id", F.col(path).cast("string").alias("path"), "text").where(F.col("text").isNotNull())
    found = part.withColumn("_all", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("_all") > 0)
    one = found.withColumn("candidate", F.explode(F.array_distinct("_all")))
    one = one.withColumn("start", F.instr("text", F.col("candidate")))
    one = one.groupBy(_row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "doc_id", "candidate").agg(F.min(F.struct(
        "path", F.size(F.filter("_all", lambda x: x == F.col("candidate"))).alias("n"), "start",
        F.substring("text", F.greatest(F.lit(1), F.col("start") - 40), F.least(F.lit(40), F.col("start") - 1)).alias("before"),
        F.substring("text", F.col("start") + F.length("candidate"), F.lit(40)).alias("after"),
    )).alias("_at"))
    return one.select("row_key", "doc_id", "candidate", "_at.*")


def dictionary(docs: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(word, n): lower-case words of 3 to 24 letters that make up `least_share` of all or more."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(3, 24))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    return cut(counts.where(F.col("n") >= least_share * total))


def _share(column: str, pattern: str):
    return F.length(F.regexp_replace(column, pattern, "")) / F.length(column)


def features(found: DataFrame, words: DataFrame, n_docs_by_path: DataFrame) -> DataFrame:
    """`found` with the columns FEATURES."""
    c = F.col("candidate")
    found = found.withColumn(KEY, F.struct("row_key", "candidate"))  # nulls inside a struct are equal in a join
    chars = F.split(c, "")
    letters = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}]+", " "), " ")
    # letter pairs of frequent words, by their first letter
    pairs = words.select("n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i"), "word").groupBy(
        F.substring("word", F.col("i"), F.lit(2)).alias("pair")
    ).agg(F.sum("n").alias("n"))
    firsts = pairs.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("all"))
    pairs = pairs.join(firsts, F.substring("pair", 1, 1) == F.col("first")).select("pair", F.log(F.col("n") / F.col("all")).alias("log_p"))
    own_pairs = found.select(KEY, "candidate", F.explode(F.sequence(F.lit(1), F.length("candidate") - 1)).alias("i")).select(
        KEY, F.lower(F.substring("candidate", F.col("i"), F.lit(2))).alias("pair")
    )
    moved = own_pairs.join(pairs, "pair", "left").groupBy(KEY).agg(F.avg(F.coalesce("log_p", F.lit(-12.0))).alias("transitions"))
    own_words = found.select(KEY, F.explode(letters).alias("word")).where("word <> ''")
    covered = own_words.join(words.select("word"), "word").groupBy(KEY).agg(F.sum(F.length("word")).alias("_covered"))
    near = found.select(
        KEY, F.regexp_extract(F.lower("before"), r"(\p{L}+)\P{L}*$", 1).alias("w_before"), F.regexp_extract(F.lower("after"), r"^\P{L}*(\p{L}+)\b", 1).alias("w_after")
    )
    known = words.select("word", F.lit(1).alias("known"))
    around = (
        near.join(known.withColumnsRenamed({"word": "w_before", "known": "known_before"}), "w_before", "left")
        .join(known.withColumnsRenamed({"word": "w_after", "known": "known_after"}), "w_after", "left")
        .select(KEY, F.coalesce("known_before", F.lit(0)).alias("known_before"), F.coalesce("known_after", F.lit(0)).alias("known_after"))
    )
    counts = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / F.length("candidate"))
    rate = found.groupBy("path").agg(F.count(F.lit(1)).alias("_found")).join(
        n_docs_by_path, F.col("path").eqNullSafe(F.col("_path")), "inner"
    ).select(F.col("path").alias("_path"), (F.col("_found") / F.col("_docs")).alias("path_rate"))
    kind = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "1"), "_+/=-", "#####")
    made = found.select(
        "*", F.length(c).cast("double").alias("length"), _share("candidate", "[^0-9]").alias("digits"), _share("candidate", "[^A-Z]").alias("upper"),
        _share("candidate", "[A-Za-z0-9]").alias("signs"), (F.size(F.array_distinct(chars)) / F.length(c)).alias("distinct"),
        F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p)).alias("entropy"),
        ((F.length(F.regexp_replace(kind, r"(.)\1*", "x")) - 1) / F.length(c)).alias("changes"),
        F.coalesce(F.col("path").rlike("(?i)test|example|sample|fixture|mock"), F.lit(False)).cast("double").alias("path_test"),
        F.col("before").rlike(KEY_WORD).cast("double").alias("key_before"), F.col("before").rlike(r"[:=]\s*[\"']?$").cast("double").alias("assigned"),
        F.col("before").rlike(r"[\"']$").cast("double").alias("quoted"),
        _share_or_zero(F.concat("before", "after")).alias("digits_around"),
    )
    return (
        made.join(rate, F.col("path").eqNullSafe(F.col("_path")), "left").drop("_path")
        .join(moved, KEY, "left").join(covered, KEY, "left").join(around, KEY, "left")
        .withColumn("coverage", F.coalesce(F.col("_covered") / F.length("candidate"), F.lit(0.0))).drop("_covered", KEY)
        .fillna(0.0, subset=["path_rate", "transitions"]).fillna(0, subset=["known_before", "known_after"])
    )


def _share_or_zero(text):
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[^0-9]", "")) / F.length(text)).otherwise(0.0)


def known_findings(made: DataFrame) -> DataFrame:
    """Findings whose format settles whether they are secrets, with `is_secret` 1 or 0."""
    c = F.col("candidate")
    keyed = F.col("before").rlike(KEY_WORD)
    secret = c.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$") | c.rlike("^gh[pousr]_[A-Za-z0-9]{36}$") | (keyed & c.rlike("^[0-9a-f]{16,64}$"))
    plain = c.rlike("^[0-9+/=_-]+$") | c.rlike(r"^[A-Za-z]+[0-9]{0,2}$") | c.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return made.withColumn("is_secret", F.when(secret, 1).when(plain, 0)).where("is_secret IS NOT NULL")


def train(labelled: DataFrame, most: int = MOST_LABELS, trees: int = 40, depth: int = 6, seed: int = 11) -> RandomForestClassificationModel | None:
    """A forest from rows with FEATURES and `is_secret`, of which at most about `most` are used; None for one class."""
    counts = {r[0]: r[1] for r in labelled.groupBy("is_secret").count().collect()}
    if len(counts) < 2:
        return None
    part = min(1.0, most / sum(counts.values()))
    chosen = labelled.where(F.pmod(F.xxhash64(*ID), F.lit(1_000_000)) < int(part * 1_000_000))
    dealt = chosen.repartition(8, F.xxhash64(*ID)).sortWithinPartitions(*ID, "row_key")  # the same rows in the same places on any cluster
    weight = F.when(F.col("is_secret") == 1, 0.5 / counts[1]).otherwise(0.5 / counts[0]) * sum(counts.values())
    ready = _assembled(dealt).select("features", F.col("is_secret").cast("double").alias("label"), weight.alias("weight"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="weight").fit(ready)


def _assembled(made: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(made)


def scan(docs: DataFrame, path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """Per document and distinct candidate: row_key, doc_id, candidate, n, start, probability, is_secret.

    `labelled` has rows (doc_id, candidate, is_secret); without it `known_findings` labels.
    """
    found = cut(findings(docs, path))
    by_path = docs.groupBy(F.col(path).cast("string").alias("_path")).agg(F.count(F.lit(1)).alias("_docs"))
    made = cut(features(found, dictionary(docs), by_path))
    known = known_findings(made) if labelled is None else made.join(labelled.select(*ID, "is_secret"), list(ID))
    model = train(known)
    if model is None:  # nothing to tell apart: all of the one class, or all candidates if there is no label
        row = known.select("is_secret").first()
        scored = made.withColumn("probability", F.lit(float(row[0]) if row else 1.0))
    else:
        scored = model.transform(_assembled(made)).withColumn("probability", vector_to_array("probability")[1])
    return scored.select("row_key", *ID, "n", "start", "probability", (F.col("probability") >= 0.5).cast("int").alias("is_secret"))


def redacted(docs: DataFrame, secrets: DataFrame, mark: str = "[secret]") -> DataFrame:
    """`docs` with every occurrence of the secrets (row_key, candidate) of a document replaced, longest first.

    Rows without doc_id, and rows that share one, each lose their own secrets; the number of rows stays.
    Secrets given as (doc_id, candidate) go from every row of that doc_id.
    """
    longest = F.array_sort(
        F.collect_set("candidate"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    )
    key = _row_key(docs["doc_id"], docs["text"]) if "row_key" in secrets.columns else docs["doc_id"]
    own = secrets.groupBy(F.col("row_key" if "row_key" in secrets.columns else "doc_id").alias("_row")).agg(longest.alias("_secrets"))
    both = docs.join(own, key == F.col("_row"), "left")
    clean = F.aggregate("_secrets", F.col("text"), lambda t, s: F.replace(t, s, F.lit(mark)))
    return both.withColumn("text", F.when(F.col("_secrets").isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)
