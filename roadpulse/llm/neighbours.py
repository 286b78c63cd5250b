"""Nearest neighbours by collision-counting hashing with query-aware windows.

Vectors are brought to length 1, so that the nearest by cosine are the nearest by distance. Each shard of the
table keeps one sorted array of (projection, vector) for each of `projections` random directions. A query
looks at the window of half-width `width * radius` centred at its own projection, in every array; the radius grows by
the factor `grow` each round (virtual rehashing: windows expand, nothing is hashed again, and only the vectors that a
window gains on its two sides are counted, one collision each). A vector that falls
in the windows of at least `share` of the directions is a candidate and is verified with the exact cosine. The
search of a shard ends when `near` vectors nearer than the current radius are verified, or when `near` plus
`extra` candidates are.

Shards have a bounded number of rows; queries pass each shard's index as a stream. Copies of a vector within a
shard are one entry that carries its `near + 1` smallest numbers, which is all that an answer can contain, so
groups of copies of any size cost one candidate. Of each shard the `near` best per query go on; a ranking
over the shards gives the answer, ties to the smaller number.

Vectors that are null or zero or have null or non-finite components take no part, as query or candidate.
Vectors of another length than the query are no candidates. Repeated rows are separate candidates; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.llm.frames import cut

PROJECTIONS = 64
WIDTH = 1.0
SHARE = 0.66
START = 0.3
GROW = 1.15
EXTRA = 2000
SHARD_ROWS = 20_000
LEAST_SHARDS = 8
QUERY_BLOCK = 64


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding has only finite components, not all zero, as doubles."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


class Shard:
    """Sorted projections of the distinct vectors of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, near: int, seed: int, projections: int):
        same = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
        order = np.argsort(ids, kind="stable")
        _, first, group = np.unique(same[order], return_index=True, return_inverse=True)
        by_group = np.argsort(group, kind="stable")  # within a group by number
        starts = np.searchsorted(group[by_group], np.arange(len(first)))
        self.ids = [ids[order][by_group[s: min(e, s + near + 1)]] for s, e in zip(starts, [*starts[1:], len(ids)])]
        self.raw = vectors[order][first]
        self.norm = np.sqrt((self.raw * self.raw).sum(axis=1))
        self.unit = self.raw / self.norm[:, None]
        self.directions = np.random.default_rng(seed).standard_normal((projections, vectors.shape[1]))
        values = self.unit @ self.directions.T
        order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, order, axis=0).T.copy()  # one sorted array a direction
        self.order = order.T.copy()  # and which vector stands at each place of it

    def search(self, queries: np.ndarray, near: int, width: float, share: float, grow: float, extra: int):
        """For each query its verified candidates, as places among the distinct vectors."""
        unit = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
        found: list[np.ndarray] = []
        for a in range(0, len(unit), QUERY_BLOCK):
            found += self._search(unit[a: a + QUERY_BLOCK], near, width, share, grow, extra)
        return found

    def _search(self, unit: np.ndarray, near: int, width: float, share: float, grow: float, extra: int) -> list[np.ndarray]:
        n, m = self.order.shape[1], len(self.directions)
        need = math.ceil(share * m)
        centres = unit @ self.directions.T
        hits = np.zeros((len(unit), n), np.uint16)
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(unit)
        cosines: list[np.ndarray] = [np.zeros(0)] * len(unit)
        # a window [low, high) in each array, empty at first
        low = np.stack([np.searchsorted(v, c) for v, c in zip(self.sorted, centres.T)], axis=1)
        high = low.copy()
        arrays = list(self.order)
        open_, radius = np.arange(len(unit)), START
        while len(open_):
            half = width * radius
            wider_low = np.stack([np.searchsorted(v, c - half) for v, c in zip(self.sorted, centres[open_].T)], axis=1)
            wider_high = np.stack([np.searchsorted(v, c + half, "right") for v, c in zip(self.sorted, centres[open_].T)], axis=1)
            last = radius > 2 * max(1.0, np.abs(self.sorted).max() + np.abs(centres).max()) / width
            more = []
            for q, a, b in zip(open_.tolist(), wider_low, wider_high):
                # only what the windows gain on either side is counted
                gained = [v[x:y] for v, x, y in zip(arrays, a.tolist(), low[q].tolist())]
                gained += [v[x:y] for v, x, y in zip(arrays, high[q].tolist(), b.tolist())]
                before, low[q], high[q] = hits[q], a, b
                now = before + np.bincount(np.concatenate(gained), minlength=n).astype(np.uint16)
                fresh = np.flatnonzero((now >= need) & (before < need))
                hits[q] = now
                found[q] = np.concatenate([found[q], fresh])
                cosines[q] = np.concatenate([cosines[q], self.unit[fresh] @ unit[q]])
                enough = np.count_nonzero(cosines[q] >= 1 - radius * radius / 2) > near or len(found[q]) >= min(n, near + extra)
                if not (enough or last):
                    more.append(q)
            open_ = np.array(more, np.int64)
            radius *= grow
        return found


def exact_cosine(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return (rows @ q) / np.sqrt((rows * rows).sum(axis=1)) / math.sqrt(float(q @ q))


def search(vectors: DataFrame, queries: DataFrame, near: int = 5, projections: int = PROJECTIONS, width: float = WIDTH,
           share: float = SHARE, grow: float = GROW, extra: int = EXTRA, shard_rows: int = SHARD_ROWS, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the `near` nearest rows of `vectors` for each row of `queries` (vec_id, embedding).

    A row of `vectors` with the query's own number is no candidate.
    """
    base, asked = usable(vectors), usable(queries)
    shards = max(LEAST_SHARDS, math.ceil(vectors.count() / shard_rows))
    rows = base.select(F.pmod(F.xxhash64("vec_id", F.size("v")), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "v")
    # the query set passes every shard
    passing = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v")
    dealt = rows.unionByName(passing).repartition(shards, "shard").sortWithinPartitions("shard", "kind", F.size("v"), "vec_id")

    def run(batches):
        held_ids, held_rows, index, current = [], [], {}, None

        def build():
            by_length = {}
            for i, v in zip(held_ids, held_rows):
                by_length.setdefault(len(v), ([], []))
                by_length[len(v)][0].append(i)
                by_length[len(v)][1].append(v)
            return {k: Shard(np.array(i, np.int64), np.array(v), near, seed, projections) for k, (i, v) in by_length.items()}

        for batch in batches:
            shard, kind = np.asarray(batch.column("shard")), np.asarray(batch.column("kind"))
            ids, lists = np.asarray(batch.column("vec_id")), batch.column("v")
            bounds = np.asarray(lists.offsets)
            flat_values = np.asarray(lists.values)
            lengths = np.diff(bounds)
            result = ([], [], [])
            step = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0) | (np.diff(lengths) != 0)) + 1
            for a, b in zip([0, *step], [*step, len(shard)]):
                if a == b:
                    continue
                block = flat_values[bounds[a]: bounds[b]].reshape(b - a, lengths[a])
                if shard[a] != current:
                    current, held_ids, held_rows, index = shard[a], [], [], None
                if kind[a] == 0:
                    held_ids += ids[a:b].tolist()
                    held_rows += list(block.copy())
                    continue
                if index is None:
                    index = build()
                    held_ids, held_rows = [], []
                if lengths[a] not in index:
                    continue
                s = index[lengths[a]]
                for own, q, found in zip(ids[a:b], block, s.search(block, near, width, share, grow, extra)):
                    if not len(found):
                        continue
                    score = exact_cosine(q, s.raw[found])
                    names = np.concatenate([s.ids[f] for f in found])
                    score = np.repeat(score, [len(s.ids[f]) for f in found])
                    keep = names != own
                    names, score = names[keep], score[keep]
                    best = np.lexsort((names, -score))[:near]
                    result[0].append(np.full(len(best), own))
                    result[1].append(names[best])
                    result[2].append(score[best])
            if result[0]:
                yield pa.RecordBatch.from_pydict(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, result))))

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= near).select("query_id", "rank", "vec_id", "score")
