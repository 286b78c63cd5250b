"""Documents that contain benchmark items, by q-gram lemma filtering and banded alignment.

Texts and items are lower-cased and every run of bytes that are neither letters nor digits becomes one space.
An item of `m` bytes may differ by `k = errors * m` edits. By the q-gram lemma a region within k edits shares at
least m - q + 1 - q k q-grams with the item, all on neighbouring diagonals. Shared q-grams are counted in
overlapping bands of diagonals, each 2 (k + 1) wide and starting k + 1 after the one before, so that every
region has its q-grams in one band. Bands that reach the bound are aligned: the least number of edits that turn
the item into some part of the region, computed along the band, must be at most k.

`k` is lowered where the bound would not be positive. Items of fewer than `least` bytes after normalising are
too short to tell and never match; null items and null or empty texts never match. Repeated items all count.
Items go to the tasks in blocks of a bounded number of bytes, one pass over the documents each. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.frames import arrow_filter, arrow_map, flat, stored

Q = 8
ERRORS = 0.05
LEAST = 24
BLOCK_BYTES = 8 << 20
PAIRS = 1 << 18
BANDS = 1 << 24

PLAIN = np.full(256, 0x20, np.uint8)
PLAIN[0x80:] = np.arange(0x80, 0x100)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B)):
    PLAIN[_a:_b] = np.arange(_a, _b)
PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)


def normal(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and their rows; runs of spaces and spaces at a row's start fall away."""
    out = PLAIN[raw]
    space = out == 0x20
    first = np.ones(len(out), bool)
    first[1:] = rows[1:] != rows[:-1]
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep &= ~(space & first)
    return out[keep], rows[keep]


def _normal_text(text: str) -> bytes:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return normal(raw, np.zeros(len(raw), np.int64))[0].tobytes().strip()


def grams(data: np.ndarray) -> np.ndarray:
    """The Q bytes from each position on as one number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(Q):
        out = (out << np.uint64(8)) | data[i: i + n]
    return out


def prepare(items: list[tuple[int, str]], errors: float = ERRORS, least: int = LEAST) -> dict:
    """Index of one block of items: sorted q-grams with item and place, and each item's edits and bound."""
    kept = [(i, t) for i, t in ((i, _normal_text(t)) for i, t in items if t is not None) if len(t) >= max(least, Q)]
    lengths = np.array([len(t) for _, t in kept], np.int64)
    edits = np.minimum((errors * lengths).astype(np.int64), np.maximum(0, (lengths - Q) // Q))
    keys = [grams(np.frombuffer(t, np.uint8)) for _, t in kept]
    n = [len(k) for k in keys]
    all_keys = np.concatenate([*keys, np.zeros(0, np.uint64)])
    order = np.argsort(all_keys, kind="stable")
    item = np.repeat(np.arange(len(kept)), n)[order]
    place = np.concatenate([*(np.arange(x) for x in n), np.zeros(0, np.int64)]).astype(np.int64)[order]
    bits = np.zeros(1 << 22, bool)
    bits[_short(all_keys)] = True
    unique, first, which = np.unique(all_keys[order], return_index=True, return_inverse=True)
    # places of an item that follow each other under one q-gram are one run
    starts = np.ones(len(item), bool)
    starts[1:] = (np.diff(which) != 0) | (np.diff(item) != 0) | (np.diff(place) != 1)
    begin = np.flatnonzero(starts)
    return {"ids": [i for i, _ in kept], "texts": [t for _, t in kept], "edits": edits, "bound": lengths - Q + 1 - Q * edits,
            "keys": unique, "bits": bits, "runs_first": np.searchsorted(begin, np.append(first, len(item))), "run_item": item[begin],
            "run_place": place[begin], "run_length": np.diff(np.append(begin, len(item)))}


def _short(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


def least_edits(item: bytes, region: bytes, enough: int) -> int:
    """Edits that turn `item` into the nearest part of `region`; stops early above `enough`."""
    if item in region:
        return 0
    b = np.frombuffer(region, np.uint8)
    steps = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    for n, c in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = n
        new[1:] = np.minimum(row[:-1] + (b != c), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
        if row.min() > enough:
            return enough + 1
    return int(row.min())


def _until(x: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Pairs (i, j) with 0 <= i < m, 0 <= j < n and i - j <= x."""
    triangle = lambda y: np.where(y > 0, y * (y + 1) // 2, 0)
    k = np.clip(x + n, 0, m + n - 1)
    return triangle(k) - triangle(k - m) - triangle(k - n) + triangle(k - m - n)


def _full_bands(index: dict, rows: np.ndarray, at: np.ndarray, spot: np.ndarray, n_rows: int) -> np.ndarray:
    """Codes of the bands (band, item, row) whose shared q-grams reach the bound.

    `at` are the text places with a q-gram of the index, `spot` its number there. A q-gram that stands at `m` places
    in a row of the text and at `n` in a row of the item shares m n of them; a band's part of these is counted by
    a formula. Runs meet in steps of at most PAIRS bands; a band that no later place can reach is judged and dropped.
    """
    # runs of one q-gram in the text, and of places of an item under one q-gram
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(spot) != 0) | (rows[at[1:]] != rows[at[:-1]])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at)))
    p, s = at[begin], spot[begin]
    first = index["runs_first"]
    many = first[s + 1] - first[s]
    ends = np.cumsum(many)
    n_items, total = len(index["ids"]), int(many.sum())
    reach = np.array([len(t) for t in index["texts"]], np.int64)
    kept, codes, counts = [np.zeros(0, np.int64)], np.zeros(0, np.int64), np.zeros(0, np.int64)

    def bounds(code):
        return index["bound"][code // n_rows % n_items]

    a = 0
    while a < total:
        pair = np.arange(a, min(total, a + PAIRS))
        run = np.searchsorted(ends, pair, "right")
        entry = first[s[run]] + pair - (ends[run] - many[run])
        item, m, n = index["run_item"][entry], length[run], index["run_length"][entry]
        width = index["edits"][item] + 1
        d0 = p[run] - index["run_place"][entry]
        low, high = (d0 - n + 1) // width - 1, (d0 + m - 1) // width
        sizes = high - low + 1
        few = max(1, int(np.searchsorted(np.cumsum(sizes), PAIRS, "right")))
        item, m, n, width, d0, low, sizes, run = (x[:few] for x in (item, m, n, width, d0, low, sizes, run))
        row = rows[p[run]]
        # one q-gram with one q-gram: one for each of two bands
        one = m * n == 1
        lower = ((low[one] + BANDS) * n_items + item[one]) * n_rows + row[one]
        found, times = np.unique(np.concatenate([lower, lower + n_items * n_rows]), return_counts=True)
        item, m, n, width, d0, low, sizes, row = (x[~one] for x in (item, m, n, width, d0, low, sizes, row))
        each = np.repeat(np.arange(len(sizes)), sizes)
        band = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = band * width[each] - d0[each]
        inside = _until(left + 2 * width[each] - 1, m[each], n[each]) - _until(left - 1, m[each], n[each])
        code = ((band + BANDS) * n_items + item[each]) * n_rows + row[each]
        codes, counts = np.concatenate([codes, code]), np.concatenate([counts, inside])
        if len(codes):  # sums where a band was met before or by a run
            codes, place = np.unique(codes, return_inverse=True)
            counts = np.bincount(place, counts, len(codes)).astype(np.int64)
            spot_ = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
            known = codes[spot_] == found
            counts[spot_[known]] += times[known]
            found, times = found[~known], times[~known]
        codes, counts = np.concatenate([codes, found]), np.concatenate([counts, times])
        full = counts >= bounds(codes)
        kept.append(codes[full])
        if a + few < total:  # a full band is noted again if it fills again; one that a later place reaches stays open
            item = codes // n_rows % n_items
            last = (codes // n_rows // n_items - BANDS + 2) * (index["edits"][item] + 1) + reach[item]
            open_ = (last >= p[run[-1]]) & ~full
            codes, counts = codes[open_], counts[open_]
        a += few
    return np.unique(np.concatenate(kept))


def contained(column: pa.Array, index: dict) -> list[list[int]]:
    """For each text the numbers of the items it contains."""
    out: list[list[int]] = [[] for _ in range(len(column))]
    raw, bounds = flat(column)
    if not len(raw) or not index["ids"]:
        return out
    data, rows = normal(raw, np.repeat(np.arange(len(column)), np.diff(bounds)))
    keys = grams(data)
    at = np.flatnonzero(index["bits"][_short(keys)])
    at = at[rows[at] == rows[at + Q - 1]]
    spot = np.minimum(np.searchsorted(index["keys"], keys[at]), len(index["keys"]) - 1)
    good = index["keys"][spot] == keys[at]
    at, spot = at[good], spot[good]
    found: dict[tuple[int, int], bool] = {}
    n_items = len(index["ids"])
    codes = _full_bands(index, rows, at, spot, len(column))
    for c in codes.tolist():
        row, i = c % len(column), c // len(column) % n_items
        if found.get((row, i)):
            continue
        k, text = int(index["edits"][i]), index["texts"][i]
        start = (c // len(column) // n_items - BANDS) * (k + 1)
        inside = np.searchsorted(rows, [row, row + 1])
        a, b = max(inside[0], start - k), min(inside[1], start + 2 * (k + 1) + len(text) + k)
        found[row, i] = least_edits(text, data[max(0, a): max(0, b)].tobytes(), k) <= k
    for (row, i), yes in found.items():
        if yes:
            out[row].append(index["ids"][i])
    return [sorted(x) for x in out]


def _blocks(benchmark: DataFrame, errors: float, least: int, block_bytes: int) -> Iterator:
    """Broadcast indexes of the items, of about `block_bytes` each."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for block in range(blocks):
        mine = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text")
        yield benchmark.sparkSession.sparkContext.broadcast(prepare([(r[0], r[1]) for r in mine.collect()], errors, least))


def matches(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id and `items`, the numbers of the benchmark items (item_id, text) found in the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = list(_blocks(benchmark, errors, least, block_bytes))
    rows, key = docs.select("doc_id", "text"), ""
    if len(held) > 1:  # a written number of each row brings its blocks together, whatever its doc_id
        rows, key = stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered"), "row long, "
    found = None
    for index in held:

        def search(batch: pa.RecordBatch, index=index) -> dict:
            items = contained(batch.column("text"), index.value)
            own = {"row": batch.column("row")} if key else {}
            return {**own, "doc_id": batch.column("doc_id"), "items": pa.array(items, pa.list_(pa.int64()))}

        part = arrow_map(rows, search, f"{key}doc_id {kind}, items array<bigint>")
        found = part if found is None else found.unionByName(part)
    if key:
        items = F.array_sort(F.flatten(F.collect_list("items"))).alias("items")
        found = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), items).drop("row")
    return found


def without_items(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, least: int = LEAST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` that contain no item; each row is judged on its own text, and a block sees what the blocks before it left."""
    for index in _blocks(benchmark, errors, least, block_bytes):

        def clean(batch: pa.RecordBatch, index=index) -> list[bool]:
            return [not items for items in contained(batch.column("text"), index.value)]

        docs = arrow_filter(docs, clean)
    return docs
