"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts the n-grams inside words per language over all labelled documents. A language keeps an n-gram
that makes up at least `least_share` of its n-grams and of which it has at least `least_part` when shares are
added over the languages, so rare foreign passages teach a language nothing. The filter holds a bit mask of
languages in each slot; an n-gram of a language sets the language's bit in `hashes` slots. AND over the slots
of an n-gram gives all languages that contain it at once. Per document the set bits are counted per language;
with `f` the share of n-grams that a language's filter would accept by chance, (hits/n - f) / (1 - f) is the
corrected share. The largest one decides; ties go to the smaller name by code point.

Bounds: a language has at most 1 / least_share n-grams, and there are at most 64 languages (more raise an
error), so the model collected on the driver has a size fixed by parameters.

Null, empty and letterless texts are `und` with score 0. Null `lang` rows teach nothing. Extra columns are
ignored by `predict` and repeated rows are predicted each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.frames import arrow_filter, arrow_map, slices
from roadpulse.llm.grams import GramSums, gram_keys, mixed

ORDER = 5
LEAST_SHARE = 2e-6
LEAST_PART = 0.1
HASHES = 4
UNKNOWN = "und"


@dataclass
class LanguageFilter:
    languages: list[str]
    slots: np.ndarray  # masks of languages
    order: int
    hashes: int
    chance: np.ndarray  # share of unknown n-grams that each language accepts

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram the bits of the languages that contain it."""
        return _and_slots(self.slots, keys, self.hashes)


def _places(keys: np.ndarray, hashes: int, size: int):
    first, second = mixed(keys, 1), mixed(keys, 2) | np.uint64(1)
    for i in range(hashes):
        yield ((first + np.uint64(i) * second) & np.uint64(size - 1)).astype(np.int64)


def _and_slots(slots: np.ndarray, keys: np.ndarray, hashes: int) -> np.ndarray:
    out = None
    for place in _places(keys, hashes, len(slots)):
        out = slots[place] if out is None else out & slots[place]
    return out


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all rows with a language; summed per task before the shuffle."""

    def count(part: pa.RecordBatch) -> dict:
        keys, rows = gram_keys(part.column("text"), order)
        coded = pc.dictionary_encode(part.column("lang"))
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        found = {}
        for i, name in enumerate(names):
            found[name] = np.unique(keys[code[rows] == i], return_counts=True)
        return found

    def run(batches):
        sums: dict[str, GramSums] = {}
        for batch in batches:
            for part in slices(batch):
                for name, (grams, counts) in count(part).items():
                    if sums.setdefault(name, GramSums(1)).add(grams, counts[:, None]):
                        yield from rows_of(name, sums.pop(name))
        for name, held in sums.items():
            yield from rows_of(name, held)

    def rows_of(name, held):
        grams, counts = held.sums()
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(grams), pa.string()), "gram": grams.view(np.int64), "n": counts[:, 0]})

    part = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    return part.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kept_grams(counts: DataFrame, least_share: float = LEAST_SHARE, least_part: float = LEAST_PART) -> DataFrame:
    """(lang, gram): the n-grams that each language keeps."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    # one row per n-gram; its languages are at most 64
    by_gram = shares.groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("all"))
    whole = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["share"])
    kept = F.filter("all", lambda x: (x["share"] >= least_share) & (x["share"] >= least_part * F.col("whole")))
    return by_gram.withColumn("whole", whole).select("gram", F.explode(kept).alias("x")).select("x.lang", "gram")


def train(docs: DataFrame, order: int = ORDER, least_share: float = LEAST_SHARE, least_part: float = LEAST_PART,
          hashes: int = HASHES) -> LanguageFilter:
    """Fits the filter on rows (text, lang)."""
    rows = kept_grams(gram_counts(docs, order), least_share, least_part).toArrow()
    name_of, gram_of = np.array(rows.column("lang").to_pylist(), object), np.asarray(rows.column("gram"))
    languages = sorted(set(name_of), key=lambda x: x.encode())
    if len(languages) > 64:
        raise ValueError("a mask holds 64 languages")
    size = 1 << max(10, int(np.ceil(np.log2(max(1, len(gram_of)) * hashes * 4))))
    slots = np.zeros(size, np.uint64)
    for i, name in enumerate(languages):
        keys = gram_of[name_of == name].view(np.uint64)
        for place in _places(keys, hashes, size):
            slots[place] |= np.uint64(1 << i)
    bits = np.array([1 << i for i in range(len(languages))], np.uint64)
    chance = np.array([np.mean((slots & b) != 0) ** hashes for b in bits])
    return LanguageFilter(languages, slots, order, hashes, chance)


def _scores(held, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and known share of each text, from the broadcast parts of a filter."""
    m = LanguageFilter(**held.value)
    n_rows, k = len(text), len(m.languages)
    text = text.fill_null("")
    keys, rows = gram_keys(text, m.order)
    masks = m.masks(keys)
    n = np.bincount(rows, minlength=n_rows)
    share = np.zeros((n_rows, max(k, 1)))
    for i in range(k):
        hit = np.bincount(rows[(masks >> np.uint64(i)) & np.uint64(1) != 0], minlength=n_rows)
        share[:, i] = np.clip((hit / np.maximum(n, 1) - m.chance[i]) / (1 - m.chance[i]), 0, 1)
    letters = np.asarray(pc.match_substring_regex(text, r"\p{L}"))
    best = share.argmax(axis=1)
    known = share[np.arange(n_rows), best]
    total = share.sum(axis=1)
    score = np.where(letters & (total > 0), known / np.where(total > 0, total, 1), 0.0)
    names = [m.languages[b] if ok and k else UNKNOWN for b, ok in zip(best, letters)]
    return names, score, np.where(letters, known, 0.0)


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """Per row: doc_id, lang_pred, score (the language's part of all corrected shares), known (its corrected share)."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values: executors need no class of this package
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batch: pa.RecordBatch) -> dict:
        names, score, known = _scores(held, batch.column("text"))
        return {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": score, "known": known}

    return arrow_map(docs.select("doc_id", "text"), score, f"doc_id {kind}, lang_pred string, score double, known double")


def in_known_language(docs: DataFrame, model: LanguageFilter, least: float = 0.2) -> DataFrame:
    """The rows of `docs` with a letter of which some language knows a part of at least `least`; each row is judged on its own text."""
    held = docs.sparkSession.sparkContext.broadcast(vars(model))

    def keep(batch: pa.RecordBatch) -> np.ndarray:
        names, _, known = _scores(held, batch.column("text"))
        return (np.array(names, object) != UNKNOWN) & (known >= least)

    return arrow_filter(docs, keep)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the number as text, modulo `parts`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts
