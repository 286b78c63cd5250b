"""Character n-grams as 64-bit numbers, their sums, and filters of such numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.frames import arrow_map, flat

LETTER = np.zeros(256, bool)
LETTER[ord("a"): ord("z") + 1] = True
LETTER[0x80:] = True
EDGE = 1
FILTER_BITS = 1 << 26
CHUNK_WORDS = 1 << 13


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 bytes with everything but letters as EDGE, and the row of each.

    One EDGE stands before the first row and one after each row.
    """
    raw, bounds = flat(pc.utf8_lower(column.cast(pa.large_string())))
    n = len(bounds) - 1
    rows = np.repeat(np.arange(n), np.diff(bounds))
    out = np.full(len(raw) + n + 1, EDGE, np.uint8)
    out[np.arange(1, len(raw) + 1) + rows] = np.where(LETTER[raw], raw, EDGE)
    return out, np.concatenate([[0], np.repeat(np.arange(n), np.diff(bounds) + 1)])


def gram_keys(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each letter and each end of a word: the up to `order` symbols that end there, within the word.

    The place before a word's first letter counts as one EDGE. Returns the keys (one byte a symbol, the
    latest in the lowest byte) and the row of each key. `order` is at most 8.
    """
    s, rows = symbols(column)
    edge = s == EDGE
    wide = s.astype(np.uint64)
    keys, inside = wide.copy(), np.ones(len(s), bool)
    inside[0] = False
    for lag in range(1, order):
        if lag > 1:
            inside[lag - 1:] &= ~edge[: len(s) - lag + 1]
            inside[: lag] = False
        add = wide[: len(s) - lag] << np.uint64(8 * lag)
        keys[lag:] |= np.where(inside[lag:], add, np.uint64(0))
    keep = ~edge
    keep[1:] |= ~edge[:-1]
    return keys[keep], rows[keep]


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing of keys (multiply and shift, three rounds)."""
    x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x ^= x >> np.uint64(30)
        x = x * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class GramSums:
    """Sums of counts by key for one task, held as sorted arrays of a bounded size."""

    MOST = 2_000_000

    def __init__(self, columns: int):
        self.keys, self.counts, self.waiting = np.zeros(0, np.uint64), np.zeros((0, columns), np.int64), []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> bool:
        """Adds sorted distinct keys; True if the sums are large enough to be passed on."""
        self.waiting.append((keys, counts))
        if sum(len(k) for k, _ in self.waiting) > max(500_000, len(self.keys)):
            self.sums()
        return len(self.keys) > self.MOST

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            keys, place = np.unique(np.concatenate([self.keys, *(k for k, _ in self.waiting)]), return_inverse=True)
            parts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
            order = np.argsort(place, kind="stable")
            starts = np.searchsorted(place[order], np.arange(len(keys)))
            self.counts = np.add.reduceat(parts[order], starts, axis=0) if len(keys) else parts
            self.keys, self.waiting = keys, []
        return self.keys, self.counts


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mixed(keys, seed) & np.uint64(bits - 1)).astype(np.int64) for seed in (31, 32)]


def key_bits(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of `bits` bits (a power of two) that holds the longs of `keys` (g); it reaches the driver as packed chunks."""

    def marks(batch: pa.RecordBatch) -> dict:
        place = np.concatenate(_places(np.asarray(batch.column("g")).view(np.uint64), bits))
        return {"word": place >> 6, "bit": (np.uint64(1) << (place & 63).astype(np.uint64)).view(np.int64)}

    def pack(group: pa.Table) -> pa.Table:
        words = np.zeros(CHUNK_WORDS, np.int64)
        words[np.asarray(group.column("word")) % CHUNK_WORDS] = np.asarray(group.column("bits"))
        return pa.table({"chunk": [int(np.asarray(group.column("word"))[0]) // CHUNK_WORDS], "packed": [words.tobytes()]})

    words = arrow_map(keys, marks, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    chunks = words.groupBy(F.expr(f"word DIV {CHUNK_WORDS}")).applyInArrow(pack, "chunk long, packed binary").toArrow()
    out = np.zeros(bits // 64, np.int64)
    for batch in chunks.to_batches():
        for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("packed")):
            out[chunk * CHUNK_WORDS: (chunk + 1) * CHUNK_WORDS] = np.frombuffer(packed.as_buffer(), np.int64)
    return out.view(np.uint64)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter holds; a few others pass by chance."""
    held = [(bits[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) for p in _places(keys, 64 * len(bits))]
    return (held[0] & held[1]).astype(bool)
