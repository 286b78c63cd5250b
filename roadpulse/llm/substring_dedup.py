"""Repeated word windows, found with a compressed FM-index per shard.

Each shard holds the halves of regions of some keys (see `repeats`). Its index is the Burrows-Wheeler transform of these
pieces, sorted by 32 words of context, in a wavelet matrix whose bit vectors are packed words with block
counts. The shard's documents then pass it from right to left by backward search: with the 20 words that start at
a place goes an interval of the index, whose width is the number of their occurrences and whose smallest
text position is the first. From one place to the next the last word is dropped (the interval grows to that of
19 common words) and the word before is added with two rank queries, so the matching statistics of a document,
cut at the window's length, cost one step a word. All documents of a shard take their steps together.

Null and empty texts have no words. Repeated rows (equal doc_id) share their spans, and none of them counts as
earlier than the other. Rows without doc_id are no place that a window could repeat and keep all their words. Long texts are
taken whole, in pieces of a few million tokens; an empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roadpulse.llm.frames import WHITE
from roadpulse.llm.grams import mixed
from roadpulse.llm.repeats import covered, gram_hashes, repeated_spans, window_hash, with_spans

WINDOW = 20
GRAM = 4
CONTEXT = 32


_BYTES = mixed(np.arange(256, dtype=np.uint64), 21)


def word_values(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    raw = np.frombuffer(text, np.uint8)
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~WHITE[raw]
    change = np.diff(solid)
    return window_hash(_BYTES[raw])(np.flatnonzero(change == 1), np.flatnonzero(change == -1))


class PackedBits:
    """Bits in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = -(-(len(bits) + 1) // 64) * 64
        padded = np.zeros(n, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class FMIndex:
    """Counts and locates patterns of at most CONTEXT symbols in `text` (small non-negative numbers)."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - width)] = rank[width:] + 1
            key = rank * (max(n, int(rank.max()) + 1) + 2) + ahead
            order = np.argsort(key, kind="stable")
            width *= 2
            if width >= CONTEXT:
                break
            fresh = np.concatenate([[0], np.diff(key[order]) != 0]).cumsum()
            rank = np.empty(n, np.int64)
            rank[order] = fresh
        self.order = order
        moved = text[order - 1].astype(np.int64)
        top = int(text.max()) + 1
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))])
        self.levels = []
        for shift in range(max(1, top.bit_length()) - 1, -1, -1):
            bits = (moved >> shift) & 1
            self.levels.append((shift, PackedBits(bits)))
            moved = np.concatenate([moved[bits == 0], moved[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each place."""
        start = np.zeros(len(at), np.int64)
        for shift, bits in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(at)
            start = np.where(one, a + bits.zeros, start - a)
            at = np.where(one, b + bits.zeros, at - b)
        return at - start

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with `symbol` before them."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        first = self.smaller[symbol]
        return first + both[: len(low)], first + both[len(low):]

    def groups(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of the index the bounds of the rows with the same `hashes` of their context."""
        h = hashes[self.order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        starts = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        return starts[which], np.append(starts[1:], len(h))[which]


def shard(bodies: list[bytes], anchors: np.ndarray):
    """Per region: which windows repeat in the block, which are the first of their kind, and their hashes."""
    parts = [np.frombuffer(b, np.uint64) for b in bodies]
    lengths = np.array([len(p) for p in parts])
    _, ids = np.unique(np.concatenate(parts), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])  # a zero after each region
    text = np.zeros(int((lengths + 1).sum()), np.int64)
    inner = np.arange(lengths.sum()) + np.repeat(np.arange(len(parts)), lengths)
    text[inner] = ids + 1
    index = FMIndex(text)
    hash_ = window_hash(text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    n = len(text)
    starts = np.arange(n)
    shorter_low, shorter_high = index.groups(hash_(starts, np.minimum(starts + WINDOW - 1, n)) ^ (np.minimum(n - starts, WINDOW - 1)).astype(np.uint64))

    by_length = np.argsort(-lengths, kind="stable")
    low, high = np.zeros(len(parts), np.int64), np.full(len(parts), n, np.int64)
    found_low, found_high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for step in range(int(lengths.max())):
        lanes = by_length[: np.searchsorted(-lengths[by_length], -step, "left")]  # those longer than `step`
        if step >= WINDOW:
            low[lanes], high[lanes] = shorter_low[low[lanes]], shorter_high[low[lanes]]
        at = begin[lanes] + lengths[lanes] - 1 - step
        low[lanes], high[lanes] = index.extend(text[at], low[lanes], high[lanes])
        if step >= WINDOW - 1:
            found_low[at], found_high[at] = low[lanes], high[lanes]
    places = np.flatnonzero(found_low >= 0)
    cuts = np.unique(np.concatenate([found_low[places], found_high[places]]))
    least = np.minimum.reduceat(index.order, cuts[cuts < n])
    first = np.zeros(n, bool)
    first[places] = least[np.searchsorted(cuts, found_low[places])] == places
    again = found_high - found_low > 1
    keys = np.zeros(n, np.int64)
    true_hash = window_hash(np.concatenate([np.concatenate([p, [np.uint64(0)]]) for p in parts]).astype(np.uint64))
    keys[places] = true_hash(places, places + WINDOW).view(np.int64)
    slots = [slice(b, b + k - WINDOW + 1) for b, k in zip(begin.tolist(), lengths.tolist())]
    return [again[s] for s in slots], [first[s] for s in slots], [keys[s] for s in slots]


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end): word spans covered by a window of 20 words that also starts earlier."""
    return repeated_spans(docs, word_values, lambda v: gram_hashes(v, GRAM), WINDOW, GRAM, shard, keep_first=True)


def deduplicate(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by spaces; with `texts` also `kept`."""
    joined = with_spans(docs, removed_spans(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                n_words, n_removed, digests, kept_texts = [], [], [], []
                for z, spans in zip(batch.column("body").to_pylist(), batch.column("spans").to_pylist()):
                    words = open_(z).split()
                    gone = covered(len(words), spans)
                    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if gone.any() else b" ".join(words)
                    n_words.append(len(words))
                    n_removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
                    kept_texts.append(kept.decode() if texts else None)
                out = {"doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
                       "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": digests}
                yield pa.RecordBatch.from_pydict(out | ({"kept": pa.array(kept_texts, pa.string())} if texts else {}))

    return joined.mapInArrow(apply, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)
