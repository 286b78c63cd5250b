"""Repeated byte strings, found with suffix arrays built by linear grouping.

Each shard holds the halves of regions of some keys (see `repeats`). Equal strings have their anchor at the same
offset, so these pieces are read in blocks of BLOCK bytes aligned to the anchor, and a block is one symbol. Over the
shard's sequence of blocks a suffix array is built in two phases:

* grouping: suffixes start in groups by first symbol. Groups are taken in descending order; every suffix finds
  the nearest one before it in a smaller group (its previous-smaller pointer). The suffixes pointed to leave
  their groups for new ones right behind, the more often pointed to the further back, so that in the end each
  group holds the suffixes that start with the same longest Lyndon prefix;
* emission: from the smallest suffix on, the suffix before each emitted one and the chain of its pointers take
  the next places of their groups. Nothing is renamed or sorted again.

Neighbours in the suffix array that agree in 24 blocks, which every string of 400 bytes contains, form a class;
strings of a class that also agree in the bytes before and after those blocks are equal.

Null texts are empty. Repeated rows (equal doc_id) are places of their own: their strings repeat. Rows without
doc_id are no place that a string could repeat and keep all their bytes. Long texts are taken whole; an empty table gives an
empty one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roadpulse.llm.grams import mixed
from roadpulse.llm.repeats import covered, repeated_spans, window_hash, with_spans

WINDOW = 400
GRAM = 16
BLOCK = 16
WHOLE = WINDOW // BLOCK - 1
_BYTES = mixed(np.arange(256, dtype=np.uint64), 13)


def grouped_suffixes(text: list[int]) -> list[int]:
    """The suffix array of `text`, whose last symbol is smaller than all others."""
    n = len(text)
    symbols = sorted(set(text))
    count = dict.fromkeys(symbols, 0)
    for c in text:
        count[c] += 1
    start, at = {}, 0
    for c in symbols:
        start[c] = at
        at += count[c]
    group = [start[c] for c in text]  # a group is named by its first place
    size = {start[c]: count[c] for c in symbols}
    order, place, filled = [0] * n, [0] * n, dict(start)
    for i, c in enumerate(text):
        place[i] = filled[c]
        order[filled[c]] = i
        filled[c] += 1
    before = [-1] * n
    last = n  # groups are intervals: the next one down ends where this one starts
    while last > 0:
        g = group[order[last - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(order[g:last]):
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_times: dict[int, list[int]] = {}
        for j, times in pointed.items():
            by_times.setdefault(times, []).append(j)
        for times in sorted(by_times, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in by_times[times]:
                moved.setdefault(group[j], []).append(j)
            for h, members in moved.items():
                if len(members) == size[h]:
                    continue
                end = h + size[h]
                for j in members:
                    end -= 1
                    other, here = order[end], place[j]
                    order[here], place[other] = other, here
                    order[end], place[j] = j, end
                size[h] -= len(members)
                size[end] = len(members)
                for j in members:
                    group[j] = end
        last = g
    out, placed = [0] * n, [False] * n
    following = {}
    out[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            to = following.get(g, g)
            out[to] = j
            following[g] = to + 1
            placed[j] = True
            j = before[j]
    return out


def byte_values(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def byte_grams(data: np.ndarray) -> np.ndarray:
    """Hashes of each GRAM consecutive bytes."""
    n = len(data) - GRAM + 1
    data = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    return mixed(eight[:n] * np.uint64(0xD6E8FEB86659FD93) + eight[8: 8 + n] * np.uint64(0xA0761D6478BD642F), 6)


def shard(bodies: list[bytes], anchors: np.ndarray):
    """Per region: which windows repeat in the block, which are the first of their kind, and their hashes."""
    lengths = np.array([len(b) for b in bodies])
    whole = np.frombuffer(b"".join(bodies), np.uint8)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    offset = anchors % BLOCK
    blocks = (lengths - offset) // BLOCK
    # one symbol a block, a zero after each region, and the smallest one at the end
    first_block = np.concatenate([[0], np.cumsum(blocks + 1)[:-1]])
    region = np.repeat(np.arange(len(bodies)), blocks)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    from_ = begin[region] + offset[region] + nth * BLOCK
    # blocks are numbered by content
    cells = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(whole, BLOCK)[from_]).view("V16").ravel()
    _, ids = np.unique(cells, return_inverse=True)
    text = np.zeros(int((blocks + 1).sum()) + 1, np.int64)
    spot = first_block[region] + nth
    text[spot] = ids.ravel() + 1
    text[-1] = -1
    order = np.array(grouped_suffixes(text.tolist()))
    sums = window_hash(_scattered(text))
    heads = sums(order, np.minimum(order + WHOLE, len(text)))
    new = np.concatenate([[0], heads[1:] != heads[:-1]])
    classes = np.empty(len(text), np.int64)
    classes[order] = np.cumsum(new)

    windows = lengths - WINDOW + 1
    owner = np.repeat(np.arange(len(bodies)), windows)
    s = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    j = -(-(s - offset[owner]) // BLOCK)
    j = np.maximum(j, 0)
    head = offset[owner] + j * BLOCK - s
    a = begin[owner] + s
    bytes_ = window_hash(_BYTES[whole])
    middle = classes[first_block[owner] + j].astype(np.uint64)
    back = a + head + WHOLE * BLOCK
    key = mixed(middle * np.uint64(31) + head.astype(np.uint64), 1) ^ mixed(bytes_(a, a + head), 2) ^ mixed(bytes_(back, a + WINDOW), 3)
    _, lead_at, which, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    again, lead = times[which.ravel()] > 1, np.zeros(len(key), bool)
    lead[lead_at] = True
    full = bytes_(a, a + WINDOW).view(np.int64)
    bounds = np.cumsum(windows)[:-1]
    return np.split(again, bounds), np.split(lead, bounds), np.split(full, bounds)


def _scattered(values: np.ndarray) -> np.ndarray:
    return mixed(values.astype(np.uint64), 17)


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end): byte spans covered by a string of 400 bytes that also starts elsewhere."""
    return repeated_spans(docs, byte_values, byte_grams, WINDOW, GRAM, shard, keep_first=False)


def deduplicate(docs: DataFrame, kept_bytes: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the kept bytes; with `kept_bytes` also `kept`."""
    joined = with_spans(docs, removed_spans(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                rows = []
                for z, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist()):
                    raw = np.frombuffer(open_(z), np.uint8)
                    gone = covered(len(raw), spans)
                    n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                    kept = raw[~gone].tobytes()
                    rows.append((len(raw), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept if kept_bytes else None))
                out = {"doc_id": batch.column("doc_id")}
                for i, (name, type_) in enumerate((("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()))):
                    out[name] = pa.array([r[i] for r in rows], type_)
                yield pa.RecordBatch.from_pydict(out | ({"kept": pa.array([r[4] for r in rows], pa.binary())} if kept_bytes else {}))

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_bytes
    return joined.mapInArrow(apply, schema)
