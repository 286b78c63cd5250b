"""Ranked lexical search by MaxScore with bounds on pairs of terms.

Terms are maximal runs of digits, ASCII letters and other than ASCII characters, with only A-Z lower-cased. A
term's weight is w = floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms has
m = 75 + (25 n N) div L; one occurrence of the term in an item adds the impact w * ((10^9 tf) div (1000 tf + 12 m)).

One pass over the texts keeps, per document, its length and the frequencies of the items' terms. A second pass
builds an inverted index per shard, a bounded number of such rows, and answers all items on it. Besides
each term's largest impact, the index holds for the pairs of terms that an item asks for their intersection
list's largest joint impact. A document with both terms of a pair adds at most the joint maximum, one with
either at most that term's own; the larger of the three bounds the pair, and is often well below the sum of the two
single maxima. An item's terms are matched into pairs, the ones that save most first. Terms whose joined bounds
cannot lift a document into the item's best of the shard only complete the scores of documents that other
terms bring up, and only while the bound of what is open leaves a document a chance. Bounds skip work, never
results. Each shard passes on its best per item, and a ranking over the shards gives the answer.

Items are dealt to blocks of a bounded size that go to the tasks; each block is one pass over the documents.

Null texts have no terms. Items without terms and documents without a term of an item don't appear. Repeated
rows of documents or items stand for themselves; a null doc_id comes last among equal scores. Empty tables give
an empty table. Very long texts are one row of counts. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.frames import arrow_map, stored, texts_of

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BLOCK_BYTES = 4 << 20
SHARD_POSTINGS = 2_000_000


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _blocks(items: DataFrame, most: int):
    """Lists of (place, terms) of rows of `items` (place, text) with a bounded sum of term bytes; rows arrive one partition at a time."""
    block, size = [], 0
    for place, text in items.select("place", "text").toLocalIterator():
        terms = terms_of((text or "").encode())
        if terms:
            block.append((place, terms))
            size += sum(map(len, terms))
        if size > most:
            yield block
            block, size = [], 0
    if block:
        yield block


def frequencies(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Per row: doc_id, n (its terms with repeats), terms (places in `vocabulary`) and tfs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = {t: i for i, t in enumerate(vocabulary)}
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def count(batch: pa.RecordBatch) -> dict:
        known, n, ids, tfs, ends = shared.value, [], [], [], [0]
        for text in texts_of(batch):
            found = Counter(terms_of(text))
            n.append(found.total())
            for term in found.keys() & known.keys():
                ids.append(known[term])
                tfs.append(found[term])
            ends.append(len(ids))
        lists = lambda values, type_: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, type_))
        return {"doc_id": batch.column("doc_id"), "n": np.array(n, np.int64), "terms": lists(ids, pa.int32()), "tfs": lists(tfs, pa.int64())}

    return arrow_map(docs.select("doc_id", "text"), count, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


class Shard:
    """Inverted index of one shard's rows: per term the sorted places of its rows and their impacts."""

    def __init__(self, terms: np.ndarray, rows: np.ndarray, impacts: np.ndarray, size: int):
        order = np.lexsort((rows, terms))
        terms, self.rows, self.impacts, self.size = terms[order], rows[order], impacts[order], size
        self.terms, starts = np.unique(terms, return_index=True)
        bounds = [*starts.tolist(), len(terms)]
        self.spans = {t: (a, b) for t, a, b in zip(self.terms.tolist(), bounds, bounds[1:])}
        self.top = {t: int(self.impacts[a:b].max()) for t, (a, b) in self.spans.items()}
        self.joint: dict[tuple[int, int], int] = {}

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.spans[term]
        return self.rows[a:b], self.impacts[a:b]

    def pair_tops(self, pairs: set[tuple[tuple[int, int], tuple[int, int]]]) -> None:
        """Largest joint impact over the intersection list of each pair ((term, times), (term, times)); 0 if that is empty."""
        dense, dense_of = np.zeros(self.size, np.int64), None
        for one, other in sorted(pairs):
            if one != dense_of:  # pairs of one term share its list, laid out by row
                if dense_of is not None:
                    dense[self.list_of(dense_of[0])[0]] = 0
                rows, impacts = self.list_of(one[0])
                dense[rows], dense_of = impacts * one[1] + 1, one
            rows, impacts = self.list_of(other[0])
            held = dense[rows]
            both = held > 0
            self.joint[one, other] = int((held[both] - 1 + impacts[both] * other[1]).max(initial=0))

    def matched(self, asked: list[tuple[int, int]]) -> list[tuple[int, list[tuple[int, int]]]]:
        """The item's terms as groups of one or two with the bound of each, lowest bound first."""
        top = {x: self.top[x[0]] * x[1] for x in asked}
        saved = []
        for i, a in enumerate(asked):
            for b in asked[i + 1:]:
                pair = (a, b) if (a, b) in self.joint else (b, a)
                if pair in self.joint:
                    bound = max(top[a], top[b], self.joint[pair])
                    saved.append((top[a] + top[b] - bound, bound, a, b))
        groups, left = [], set(asked)
        for gain, bound, a, b in sorted(saved, reverse=True):
            if gain > 0 and a in left and b in left:
                groups.append((bound, [a, b]))
                left -= {a, b}
        return sorted(groups + [(top[x], [x]) for x in left])

    def best(self, asked: list[tuple[int, int]], near: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the `near` best rows; `order` ranks rows of equal score."""
        groups = self.matched([x for x in asked if x[0] in self.spans])
        below = np.concatenate([[0], np.cumsum([bound for bound, _ in groups])]) if groups else np.zeros(1)
        score, seen = np.zeros(self.size, np.int64), np.zeros(self.size, bool)
        least, at = 0, len(groups)
        while at > 0 and below[at] > least:  # groups that alone can bring a document up
            at -= 1
            for term, times in groups[at][1]:
                rows, impacts = self.list_of(term)
                score[rows] += impacts * times
                seen[rows] = True
            if np.count_nonzero(seen) >= near:
                least = max(least, int(np.partition(score[seen], -near)[-near]) - 1)  # equal scores stay in
        rows = np.flatnonzero(seen)
        for rest in range(at, 0, -1):  # the others complete what has a chance
            rows = rows[score[rows] + below[rest] > least]
            if len(rows) >= near:
                least = max(least, int(np.partition(score[rows], -near)[-near]) - 1)
            for term, times in groups[rest - 1][1]:
                own, impacts = self.list_of(term)
                spot = np.minimum(np.searchsorted(own, rows), len(own) - 1)
                score[rows] += np.where(own[spot] == rows, impacts[spot] * times, 0)
        rows = rows[score[rows] > 0]
        rows = rows[np.lexsort((order[rows], -score[rows]))[:near]]
        return rows, score[rows]


def chosen_pairs(shard: Shard, asked: list[tuple[int, int]]) -> set:
    """Neighbours by their single bounds, which is where one bound decides most: two for each term of an item at most."""
    own = sorted((x for x in asked if x[0] in shard.spans), key=lambda x: (shard.top[x[0]] * x[1], x))
    return {tuple(sorted(p)) for gap in (1, 2) for p in zip(own, own[gap:])}


def _search_block(docs: DataFrame, block: list, near: int, shard_postings: int) -> DataFrame:
    """(place, score, doc_id): the best of each shard for each item of the block."""
    vocabulary = sorted({t for _, terms in block for t in terms})
    place_of = {t: i for i, t in enumerate(vocabulary)}
    counted = stored(frequencies(docs, vocabulary), "frequencies")
    n_docs, length = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()  # at most the items' terms
    weights = np.zeros(len(vocabulary), np.int64)
    for t, df in held:
        weights[t] = weight(n_docs, df)
    asked = [(place, sorted((place_of[t], times) for t, times in Counter(terms).items())) for place, terms in block]
    shared = docs.sparkSession.sparkContext.broadcast((asked, weights))

    def answers(ids: list, n: list, ends: list, terms: list, tfs: list) -> pa.RecordBatch:
        items, w = shared.value
        names = pa.concat_arrays(ids)
        lengths, sizes = np.concatenate(n), np.concatenate(ends)
        term, tf = np.concatenate(terms), np.concatenate(tfs)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        m = 75 + (25 * lengths * n_docs) // max(length, 1)
        impacts = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[rows]))
        shard = Shard(term, rows, impacts, len(sizes))
        by_name = pc.array_sort_indices(names, null_placement="at_end")
        order = np.empty(len(sizes), np.int64)
        order[np.asarray(by_name)] = np.arange(len(sizes))
        shard.pair_tops({p for _, own in items for p in chosen_pairs(shard, own)})
        found = [(place, *shard.best(own, near, order)) for place, own in items]
        total = [np.full(len(r), place, np.int64) for place, r, _ in found]
        picked = np.concatenate([np.zeros(0, np.int64), *(r for _, r, _ in found)])
        return pa.RecordBatch.from_pydict({
            "place": np.concatenate([np.zeros(0, np.int64), *total]), "score": np.concatenate([np.zeros(0, np.int64), *(s for *_, s in found)]),
            "doc_id": names.take(pa.array(picked)),
        })

    def run(batches):
        waiting, size = ([], [], [], [], []), 0
        for batch in batches:
            lists = batch.column("terms")
            bounds = np.asarray(lists.offsets)
            values = (np.asarray(lists.values)[bounds[0]: bounds[-1]], np.asarray(batch.column("tfs").flatten()))
            for kept, part in zip(waiting, (batch.column("doc_id"), np.asarray(batch.column("n")), np.diff(bounds), *values)):
                kept.append(part)
            size += len(values[0])
            if size > shard_postings:
                yield answers(*waiting)
                waiting, size = ([], [], [], [], []), 0
        if waiting[0]:
            yield answers(*waiting)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return counted.mapInArrow(run, f"place long, score long, doc_id {kind}")


def search(docs: DataFrame, items: DataFrame, near: int = 20, block_bytes: int = BLOCK_BYTES, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `near` best rows of `docs` (doc_id, text) for each row of `items` (item_id, text).

    Only documents with a score above 0 count; equal scores rank by doc_id.
    """
    session = docs.sparkSession
    listed = stored(items.select("item_id", "text", F.monotonically_increasing_id().alias("place")), "items")  # numbered once, as written
    parts = [_search_block(docs, block, near, shard_postings) for block in _blocks(listed, block_bytes)]
    kind, doc_kind = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    if not parts:
        return session.createDataFrame([], f"item_id {kind}, rank int, doc_id {doc_kind}, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= near)
    return best.join(listed.select("item_id", "place"), "place").select("item_id", "rank", "doc_id", "score")

