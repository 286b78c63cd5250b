"""Repeated windows of tokens over a whole corpus: which tables to shuffle, and which regions to compare.

A window is `length` consecutive tokens (bytes or words) of one text. Its anchor is the gram of `gram` tokens
inside it with the smallest hash, the leftmost on ties, so equal windows have equal anchors at equal places.
Consecutive windows with the same anchor form a region; each window lies in exactly one region. A region is cut
in two: the windows with the anchor in their first half all hold the same tokens after it, the others the same
tokens before it. The hash of these shared tokens is the key of a half, so halves with equal windows have equal
keys, and an anchor that is frequent in different surroundings falls apart into many keys.

1. Keys are counted (combined before the shuffle). A window whose key is unique is unique. The others go
   into a filter of a fixed number of bits, which keeps most unique keys out of the tables that follow; what
   it lets through by chance falls away in step 2.
2. Halves of other keys are compared by the hash of their whole content. Equal halves repeat window by
   window; one of them stands for all.
3. Keys with several different contents are compared in shards: the halves of a key meet in one task
   and an index tells which windows repeat. Where very many contents hold one passage of over half a window,
   they are split by a salt, which bounds a group; each part passes on one place for every window it has
   seen, and those places are compared by window hash.

No step needs all rows of a key in one task, and no pairs are formed.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.frames import arrow_map, cut, stored
from roadpulse.llm.grams import key_bits, mixed, passes

SEGMENT = 1 << 22
PART_ROWS = 2500
BLOCK_TOKENS = 1 << 17
_PLACE = np.uint64((1 << 24) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def regions(grams: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(first window, last window, place of the anchor) of each region, from the hash of the gram at each place."""
    width = length - gram + 1
    total = len(grams) - width + 1
    for a in range(0, total, SEGMENT):
        part = grams[a: a + SEGMENT + width - 1]
        keys = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        place = (sliding_min(keys, width) & _PLACE).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        ends = np.append(starts[1:], len(place)) - 1
        yield from zip((starts + a).tolist(), (ends + a).tolist(), (place[starts] + a).tolist())


def halves(s0: int, s1: int, at: int, length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window, last window, start and end of the tokens that all of them hold) of the halves of a region."""
    middle = at - (length - gram) // 2  # the first window with the anchor in its first half
    if s1 >= middle:
        yield max(s0, middle), s1, at, middle + length
    if s0 < middle:
        yield s0, min(s1, middle - 1), middle - 1, at + gram


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, body): texts as compressed bytes, for cheaper shuffles; null texts are empty."""
    import zstandard

    kind = docs.schema["doc_id"].dataType.simpleString()

    def press(batch: pa.RecordBatch) -> dict:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        return {"doc_id": batch.column("doc_id"), "body": pa.array([squeeze(t or b"") for t in texts], pa.binary())}

    return arrow_map(docs.select("doc_id", "text"), press, f"doc_id {kind}, body binary")


def repeated_spans(docs: DataFrame, tokens: Callable, grams: Callable, length: int, gram: int, shard: Callable, keep_first: bool) -> DataFrame:
    """(doc_id, start, end): token spans covered by repeated windows, in pieces that may touch or overlap.

    `tokens(bytes)` gives a text's token array and `grams(tokens)` the hash of the gram at each place.
    `shard(bodies, anchors)` compares the halves of one block: for each which windows repeat, which are
    the first of their kind in the block's order, and their hashes. With `keep_first`
    a window's earliest place (by doc_id, then start) is not covered by it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")

    def found(text: bytes):
        t = tokens(text)
        if len(t) >= length:
            raw, unit = memoryview(t.tobytes()), t.itemsize
            for first, last, at in regions(grams(t), length, gram):
                for s0, s1, a, b in halves(first, last, at, length, gram):
                    yield raw[s0 * unit: (s1 + length) * unit], xxhash.xxh3_64_intdigest(raw[a * unit: b * unit]), s0, s1, at

    def keys(batch: pa.RecordBatch) -> dict:
        found_ = [g for text in batch.column("text").cast(pa.large_binary()).to_pylist() for _, g, _, _, _ in found(text)]
        return {"g": np.array(found_, np.uint64).view(np.int64)}

    many = arrow_map(docs.select("text"), keys, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    filter_ = docs.sparkSession.sparkContext.broadcast(key_bits(many))

    def half_rows(batch: pa.RecordBatch) -> dict:
        bits = filter_.value
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
            own = list(found(text))
            if not own:
                continue
            maybe = passes(bits, np.array([g for _, g, _, _, _ in own], np.uint64))
            for i in np.flatnonzero(maybe).tolist():
                body, g, s0, s1, at = own[i]
                for column, value in zip(out, (g, xxhash.xxh3_64_intdigest(body), doc, s0, s1, at)):
                    column.append(value)
        return {"g": np.array(out[0], np.uint64).view(np.int64), "c": np.array(out[1], np.uint64).view(np.int64),
                "doc_id": pa.array(out[2], batch.schema.field("doc_id").type), "s0": pa.array(out[3], pa.int32()),
                "s1": pa.array(out[4], pa.int32()), "at": pa.array(out[5], pa.int32())}

    rows = stored(arrow_map(docs, half_rows, f"g long, c long, doc_id {kind}, s0 int, s1 int, at int"), "regions")
    contents = stored(rows.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "s0", "s1", "at")).alias("first")), "contents")
    kinds = cut(contents.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    span = lambda df: df.select("doc_id", F.col("s0").alias("start"), (F.col("s1") + length).alias("end"))
    same = rows.join(contents.where("n > 1").select("g", "c", "first"), ["g", "c"])
    if keep_first:
        later = (F.col("doc_id") > F.col("first.doc_id")) | ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("s0") > F.col("first.s0")))
        same = same.where(later)
    wanted = contents.join(kinds, "g").select("g", "kinds", "first.*")
    parts = F.ceil(F.col("kinds") / PART_ROWS).cast("int")
    salt = F.pmod(F.xxhash64("doc_id", "s0"), parts).cast("int")
    wanted = wanted.select("doc_id", F.struct("g", salt.alias("salt"), (parts > 1).alias("split"), "s0", "s1", "at").alias("w"))
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list("w").alias("wanted"))
    bodies = packed(docs).join(by_doc, "doc_id")

    def extract(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                out: dict[str, list] = {n: [] for n in ("g", "salt", "split", "doc_id", "s0", "at", "body")}
                for doc, z, asked in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "body", "wanted"))):
                    t = tokens(open_(z))
                    for w in asked:
                        for name in ("g", "salt", "split", "s0"):
                            out[name].append(w[name])
                        out["doc_id"].append(doc)
                        out["at"].append(w["at"] - w["s0"])
                        out["body"].append(t[w["s0"]: w["s1"] + length].tobytes())
                types = {"g": pa.int64(), "salt": pa.int32(), "split": pa.bool_(), "doc_id": batch.schema.field("doc_id").type,
                         "s0": pa.int32(), "at": pa.int32(), "body": pa.binary()}
                yield pa.RecordBatch.from_pydict({n: pa.array(v, types[n]) for n, v in out.items()})

    payload = bodies.mapInArrow(extract, f"g long, salt int, split boolean, doc_id {kind}, s0 int, at int, body binary")
    dealt = payload.repartition("g", "salt").sortWithinPartitions("g", "salt", "doc_id", "s0")

    names = ("g", "salt", "split", "doc_id", "s0", "at", "body")

    def answer(held: dict[str, list], doc_type: pa.DataType) -> pa.RecordBatch:
        # parts of one key may share a block: places are compared in the order of documents, not of parts
        order = sorted(range(len(held["body"])), key=lambda r: (held["doc_id"][r], held["s0"][r]))
        held = {name: [column[r] for r in order] for name, column in held.items()}
        repeated, leads, hashes = shard(held["body"], np.array(held["at"], np.int64))
        out: dict[str, list] = {"doc_id": [], "start": [], "end": [], "window": []}

        def add(r, first, last, window):
            for name, value in zip(out, (held["doc_id"][r], held["s0"][r] + first, held["s0"][r] + last + length, window)):
                out[name].append(value)

        for r, (again, lead, keys) in enumerate(zip(repeated, leads, hashes)):
            where = np.flatnonzero(again & ~lead if keep_first else again)
            if len(where):
                for run in np.split(where, np.flatnonzero(np.diff(where) > 1) + 1):
                    add(r, int(run[0]), int(run[-1]), None)
            if held["split"][r]:  # one place of every window goes on to the other parts of its key
                for w in np.flatnonzero(lead).tolist():
                    add(r, w, w, int(keys[w]))
        types = {"doc_id": doc_type, "start": pa.int32(), "end": pa.int32(), "window": pa.int64()}
        return pa.RecordBatch.from_pydict({n: pa.array(v, types[n]) for n, v in out.items()})

    def compare(batches):
        """Groups arrive one after the other; whole groups are gathered into blocks of a bounded size."""
        held: dict[str, list] = {n: [] for n in names}
        size, last, doc_type = 0, None, None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                if size > BLOCK_TOKENS * unit and last != row[:2]:
                    yield answer(held, doc_type)
                    held, size = {n: [] for n in names}, 0
                for name, value in zip(names, row):
                    held[name].append(value)
                size, last = size + len(row[-1]), row[:2]
        if size:
            yield answer(held, doc_type)

    unit = tokens(b"a").dtype.itemsize
    judged = stored(dealt.mapInArrow(compare, f"doc_id {kind}, start int, end int, window long"), "judged")
    spans = span(same).unionByName(judged.where("window IS NULL").select("doc_id", "start", "end"))
    open_ = judged.where("window IS NOT NULL")
    across = open_.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start")).alias("first")).where("n > 1")
    met = open_.join(across, "window")
    if keep_first:
        met = met.where((F.col("doc_id") > F.col("first.doc_id")) | ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") > F.col("first.start"))))
    return spans.unionByName(met.select("doc_id", "start", "end"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, body, spans): each row of `docs` with its text packed and its own spans."""
    by_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return packed(docs).join(by_doc, "doc_id", "left")


def covered(n: int, spans: list | None) -> np.ndarray:
    """Which of `n` tokens lie in a span."""
    change = np.zeros(n + 1, np.int64)
    for s in spans or ():
        change[s["start"]] += 1
        change[s["end"]] -= 1
    return np.cumsum(change[:-1]) > 0


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of each `gram` consecutive 64-bit values."""
    n = len(values) - gram + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(gram):
        out = out * np.uint64(0x9E3779B97F4A7C15) + values[i: i + len(out)]
        out ^= out >> np.uint64(29)
    return mixed(out, 5)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the base and of its inverse modulo 2^64, kept for the next text."""
    kept = sys.modules.setdefault("_llm_powers", types.ModuleType("_llm_powers"))
    have = getattr(kept, "powers", None)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 2 * n)
        runs = [np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]) for b in (_BASE, _INVERSE)]
        have = kept.powers = tuple(np.cumprod(r, dtype=np.uint64) for r in runs)
    return have[0][: n + 1], have[1][: n + 1]


def window_hash(values: np.ndarray):
    """A function (starts, ends) -> 64-bit hashes of values[start:end], from one running sum."""
    n = len(values)
    powers, inverse = _powers(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:n], dtype=np.uint64)])
    return lambda a, b: mixed((total[b] - total[a]) * inverse[a], 9)
