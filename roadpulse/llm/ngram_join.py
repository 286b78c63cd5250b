"""Similarity join of documents on their word n-grams, by vertical partitioning.

A text's set holds the distinct runs of `words` words (ASCII letters lower-cased; with fewer words the whole
sequence). Two texts link when percent * |union| <= 100 * |intersection|. All n-grams have one global order, that of
their 64-bit hash, and the order is cut into fragments (vertical partitions), which cut each set into segments.

* Candidates. Sizes fall into classes; sets of n in a class whose largest member is `high` differ from any partner of
  n or more in at most D n-grams. The order is cut into D + 1 + x fragments for the class, so partners agree
  on at least 1 + x whole segments. If one of the two has at most x empty segments, they meet at an equal one that is
  not empty. A set with more empty segments is cut again, by another order, and so on until it has few: two
  sets meet at the first cut at which either is done, or earlier. A set is cut by its own class and as a partner by
  the class below. Whatever the data, no pair is lost, and unrelated sets rarely agree on a segment.
* Segments that only one text has are left out behind a filter sized by the number of repeated ones (it lets a few
  others pass). Texts with equal sets are one from here on.
* Counting. For each pair of sets, the overlaps of the segments of SLICES equal fragments are counted separately and
  summed per pair; the test is on integers.
* Centres. All sets that meet at a segment are paired with one of them, unless their parity sketches already differ in
  more bits than the sets may differ in n-grams, and the links that this gives are contracted to components. So copies,
  and groups that a centre links, make as many pairs as they have members.
* Groups. Sets that meet, directly or by way of others, at segments where more than one component is left form a group.
  Near copies that do not link are many there, so they are not paired with each other. A group's middle holds the n-grams
  of more than half of its sets (of two sets, those of one), and each set is known by its difference: the n-grams in which it and the middle differ.
  Two sets differ in |A| + |B| - 2 |A and B| n-grams, for differences A and B, and with a set's slack
  (100 - percent) n - (100 + percent) |A| they link when 2 (100 + percent) |A and B| >= -(slack + slack).
  Pairs whose slacks sum to 0 or more need no common n-gram; all sets in such pairs link to the one with the largest
  slack. Any other pair must share so many n-grams of A and B that it meets at one of the first of both, when each
  difference is read from its rarest n-gram on. Edits of their own put near copies far from each other there, and only
  pairs that meet are counted. Pairs still grow with the square of sets that share the same rare differences and do not link.
* Driver. It holds filters of at most 32 MB, each until the table read through it is written. Joins deal both sides out by key, and
  what is summed by a key is written before it is joined on that key, so that a large group can be split there.

Sets and n-grams stand for themselves by hashes of 128 and 64 bits. Null, empty and blank texts have an empty set
and are linked with nothing. Repeated rows and rows without doc_id are documents; a component without any doc_id
has a null component_id. Very long texts are cut like others. Empty tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.components import connected_components
from roadpulse.llm.frames import arrow_map, dealt, stored, texts_of
from roadpulse.llm.grams import key_bits, mixed, passes

WORDS = 4
PERCENT = 85
SLICES = 8
CUTS = 40
SKETCH_BITS = 1024
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles, from those of their words; none for a text without words."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    single = np.array(list(map(xxhash.xxh3_64_intdigest, parts)), np.uint64)
    width = min(words, len(parts))
    k = len(parts) - width + 1
    out = np.zeros(k, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + single[i: i + k]
    return np.unique(mixed(out, 50 + width))


class Classes:
    """Classes of set sizes: a set and its partner of the same size or more are in one class or the next."""

    def __init__(self, percent: int):
        starts = [1]
        while starts[-1] < 1 << 40:
            starts.append(100 * starts[-1] // percent + 1)
        self.starts = np.array(starts, np.int64)
        high = self.starts[1:] - 1
        # |a| + |b| - 2 |both| with |both| >= percent / (100 + percent) of the sum
        self.differ = (100 - percent) * (high + 100 * high // percent) // (100 + percent)
        self.spare = 1 + self.differ // 16
        self.fragments = self.differ + 1 + self.spare

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, n, "right") - 1


def segment_keys(sets: np.ndarray, sizes: np.ndarray, of: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the segments of each row, cut by the class `of` it (below 0: none).

    `sets` holds the rows' sorted n-grams one after the other. Sets that can differ in nothing have no keys.
    """
    use = (of >= 0) & (sizes > 0)
    use[use] = classes.differ[of[use]] > 0
    rows = np.repeat(np.arange(len(sizes)), sizes)
    grams, rows = sets[use[rows]], rows[use[rows]]
    out_rows, out_keys = [], []
    for cut in range(CUTS):
        if not len(rows):
            break
        order = grams if cut == 0 else mixed(grams, 900 + cut)
        place = ((order >> np.uint64(32)) * classes.fragments[of[rows]].astype(np.uint64)) >> np.uint64(32)
        if cut:
            by = np.lexsort((place, rows))
            grams, rows, place = grams[by], rows[by], place[by]
        starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (place[1:] != place[:-1])]))
        sums = np.add.reduceat(mixed(grams, 800), starts)
        owner = rows[starts]
        name = place[starts] + (of[owner].astype(np.uint64) << np.uint64(40)) + np.uint64(cut << 56)
        out_rows.append(owner)
        out_keys.append(mixed(sums ^ mixed(name, 801), 802))
        held = np.bincount(owner, minlength=len(sizes))
        few = np.zeros(len(sizes), bool)
        few[owner] = classes.fragments[of[owner]] - held[owner] > classes.spare[of[owner]]
        grams, rows = grams[few[rows]], rows[few[rows]]
    if len(rows):  # never done: such sets meet each other
        last = np.unique(rows)
        out_rows.append(last)
        out_keys.append(mixed(of[last].astype(np.uint64), 803))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *out_rows]), np.concatenate([empty.astype(np.uint64), *out_keys])


def sketches(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits a row, as longs: the parity of the number of n-grams in each of so many places. Two sets differ
    in at least as many n-grams as their sketches in bits."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    places = rows * SKETCH_BITS + (sets & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    odd = np.bincount(places, minlength=SKETCH_BITS * len(sizes)) & 1
    return np.packbits(odd.reshape(-1, SKETCH_BITS).astype(np.uint8), axis=1).view(np.int64)


def _lists(rows: np.ndarray, keys: np.ndarray, n: int) -> pa.ListArray:
    keys = keys[np.argsort(rows, kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)))


def _sets_of(batch: pa.RecordBatch, words: int) -> tuple[list[np.ndarray], list[bytes]]:
    import xxhash

    sets = [shingle_set(t, words) for t in texts_of(batch)]
    return sets, [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]


def signed(docs: DataFrame, words: int, classes: Classes) -> DataFrame:
    """Per row: doc_id, sid (its set's hash), n, keys of its own class (`own`) and of the class below (`below`), sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def compute(batch: pa.RecordBatch) -> dict:
        sets, sids = _sets_of(batch, words)
        sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *sets])
        of, n = classes.of(sizes), len(sets)
        bits = sketches(every, sizes)
        return {
            "doc_id": batch.column("doc_id"), "sid": pa.array(sids, pa.binary()), "n": sizes,
            "own": _lists(*segment_keys(every, sizes, of, classes), n), "below": _lists(*segment_keys(every, sizes, of - 1, classes), n),
            "sketch": pa.FixedSizeListArray.from_arrays(bits.ravel(), bits.shape[1]).cast(pa.list_(pa.int64())),
        }

    schema = f"doc_id {kind}, sid binary, n long, own array<long>, below array<long>, sketch array<long>"
    return arrow_map(docs.select("doc_id", "text"), compute, schema)


def filter_bits(keys: int) -> int:
    """Size of a filter for so many keys: 16 bits a key or more, up to 32 MB; past that more keys pass it in vain."""
    bits = LEAST_BITS
    while bits < min(16 * keys, MOST_BITS):
        bits *= 2
    return bits


def repeated_only(marked: DataFrame) -> DataFrame:
    """One row per set with the keys that more than one row of `marked` has (and a few others), numbered once, as written (`node`)."""
    counted = marked.select(F.explode(F.concat("own", "below")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("rows"))
    many = stored(counted.where("rows > 1").select("g"), "repeated")
    shared = marked.sparkSession.sparkContext.broadcast(key_bits(many, filter_bits(many.count())))

    def keep(batch: pa.RecordBatch) -> dict:
        columns = {name: batch.column(name) for name in batch.schema.names}
        for name in ("own", "below"):
            lists = batch.column(name)
            ends = np.asarray(lists.offsets)
            keys = np.asarray(lists.values)[ends[0]: ends[-1]].view(np.uint64)
            rows = np.repeat(np.arange(len(lists)), np.diff(ends))
            held = passes(shared.value, keys)
            columns[name] = _lists(rows[held], keys[held], len(lists))
        return columns

    sets = marked.drop("doc_id").where("size(own) + size(below) > 0")
    left = arrow_map(sets, keep, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sets.schema)).where("size(own) + size(below) > 0")
    held = stored(left.dropDuplicates(["sid"]).withColumn("node", F.monotonically_increasing_id()), "held")
    shared.destroy()  # what is read again is written; the driver keeps no filter
    return held


def _differ(s: str, t: str) -> Column:
    """Bits in which two sketches differ."""
    return F.aggregate(F.zip_with(s, t, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)


def _may_link(differ: Column, percent: int) -> Column:
    """Whether sizes n and m and so many sure differences leave a link possible."""
    sum_ = F.col("n") + F.col("m")
    both = F.ceil(sum_ * percent / (100 + percent) - 1e-6)
    return (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (differ <= sum_ - 2 * both)


def _met(held: DataFrame) -> DataFrame:
    """(node, key, home): the keys of each set; `home` says that the key is of the set's own class."""
    own = F.transform("own", lambda k: F.struct(k.alias("key"), F.lit(True).alias("home")))
    below = F.transform("below", lambda k: F.struct(k.alias("key"), F.lit(False).alias("home")))
    return held.select("node", F.inline(F.concat(own, below)))


def _possible(held: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(one, two, a, b, sum): the pairs (one, two) of nodes that sizes and sketches leave possible, with hashes and the sum of the sizes."""
    own = held.select(F.col("node").alias("one"), F.col("sid").alias("a"), "n", F.col("sketch").alias("s"))
    other = held.select(F.col("node").alias("two"), F.col("sid").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("t"))
    both = pairs.join(dealt(own), "one").join(dealt(other), "two").where(_may_link(_differ("s", "t"), percent))
    return both.select("one", "two", "a", "b", (F.col("n") + F.col("m")).alias("sum"))


def central_pairs(held: DataFrame, percent: int) -> DataFrame:
    """Pairs as from `_possible`: at each key the first set of the key's own class with each other set there."""
    met = _met(held)
    centres = met.where("home").groupBy("key").agg(F.min("node").alias("one"))
    pairs = met.join(dealt(centres), "key").where("node <> one").select("one", F.col("node").alias("two")).distinct()
    return _possible(held, pairs, percent)


def _head(batch: pa.RecordBatch) -> dict:
    """The first eight bytes of each hash as a long."""
    return {"g": np.frombuffer(b"".join(s[:8] for s in batch.column("sid").to_pylist()), np.int64)}


def _asked(sids: DataFrame, rows: int):
    """A broadcast filter that lets the given set hashes pass, and a few others."""
    return sids.sparkSession.sparkContext.broadcast(key_bits(arrow_map(sids, _head, "g long"), filter_bits(rows)))


def _passing(needed, sids: list[bytes]) -> list[int]:
    """Which of `sids` pass the filter."""
    return np.flatnonzero(passes(needed.value, np.frombuffer(b"".join(s[:8] for s in sids), np.uint64))).tolist()


def linked(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): the nodes of the pairs that link. Overlaps are counted per fragment of the order and summed per pair."""
    pairs = stored(pairs, "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    needed = _asked(asked, 2 * pairs.count())

    def cut(batch: pa.RecordBatch) -> dict:
        sets, sids = _sets_of(batch, words)
        out = ([], [], [])
        for k in _passing(needed, sids):
            fragment = (sets[k] >> np.uint64(32)) * np.uint64(SLICES) >> np.uint64(32)
            ends = np.searchsorted(fragment, np.arange(SLICES + 1))
            for f, (start, end) in enumerate(zip(ends, ends[1:])):
                if end > start:
                    out[0].append(sids[k])
                    out[1].append(f)
                    out[2].append(sets[k][start:end].view(np.int64))
        return {"sid": pa.array(out[0], pa.binary()), "fragment": np.array(out[1], np.int32), "segment": pa.array(out[2], pa.list_(pa.int64()))}

    cuts = arrow_map(docs.select("text"), cut, "sid binary, fragment int, segment array<long>")
    segments = stored(cuts.dropDuplicates(["sid", "fragment"]), "segments")
    needed.destroy()
    of = lambda c: dealt(segments.select(F.col("sid").alias(c), "fragment", F.col("segment").alias(f"{c}_s")))
    shared = F.size(F.array_intersect("a_s", "b_s"))
    counted = pairs.join(of("b"), "b").join(of("a"), ["a", "fragment"]).select("one", "two", "sum", shared.alias("shared"))
    both = counted.groupBy("one", "two", "sum").agg(F.sum("shared").alias("both"))
    enough = both.where(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent)
    return stored(enough.select(F.col("one").alias("a"), F.col("two").alias("b")), "links")


def groups(held: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, grp, sid, n, root): the sets at keys where more than one component is left; sets that meet there are in one group."""
    rooted = stored(held.join(dealt(roots), "node", "left").select("node", "sid", "n", F.coalesce("root", "node").alias("root")), "rooted")
    met = _met(held).join(dealt(rooted.select("node", "root")), "node")
    keys = met.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.bool_or("home").alias("own"), F.min("node").alias("a"))
    spokes = met.join(dealt(keys.where("own AND low <> high").select("key", "a")), "key").select("a", F.col("node").alias("b"))
    return stored(rooted.join(dealt(connected_components(spokes).withColumnRenamed("root", "grp")), "node"), "groups")


def differences(docs: DataFrame, grouped: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, root, grp, delta, slack): in which n-grams each set and the middle of its group differ; and (grp, g, sets):
    the n-grams that are in the differences of several sets of a group."""
    needed = _asked(grouped.select("sid"), grouped.count())

    def pick(batch: pa.RecordBatch) -> dict:
        sets, sids = _sets_of(batch, words)
        held = _passing(needed, sids)
        return {"sid": pa.array([sids[k] for k in held], pa.binary()), "grams": pa.array([sets[k].view(np.int64) for k in held], pa.list_(pa.int64()))}

    picked = arrow_map(docs.select("text"), pick, "sid binary, grams array<long>")
    sizes = stored(grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("first")), "sizes")
    sized = stored(grouped.join(dealt(sizes), "grp"), "sized")
    sets = stored(picked.dropDuplicates(["sid"]).join(dealt(sized), "sid").drop("sid"), "sets")  # not dealt by group, so n-grams are below
    needed.destroy()
    several = sets.where("members > 2").select("grp", F.explode("grams").alias("g")).groupBy("grp", "g").agg(F.count(F.lit(1)).alias("times"))
    times = several.where("times > 1").join(dealt(sizes), "grp").select("grp", "g", "times", "members", F.expr("2 * times > members").alias("most"))
    times = stored(times, "times")
    two = sets.where("members = 2 AND node = first").select("grp", F.col("grams").alias("middle"))  # one of two is the middle
    middles = times.where("most").groupBy("grp").agg(F.collect_list("g").alias("middle")).unionByName(two)
    middle = F.coalesce("middle", F.array().cast("array<long>"))
    delta = F.concat(F.array_except("grams", middle), F.array_except(middle, "grams"))
    found = sets.join(dealt(middles), "grp", "left").select("node", "root", "grp", "n", delta.alias("delta"))
    slack = (100 - percent) * F.col("n") - (100 + percent) * F.size("delta")
    rare = times.select("grp", "g", F.expr("CASE WHEN most THEN members - times ELSE times END").alias("sets"))
    return stored(found.select("node", "root", "grp", "delta", slack.alias("slack")), "differences"), rare.where("sets > 1")


def rate(deltas: DataFrame) -> DataFrame:
    """(node, root, grp, slack, hub, top, near): with the set of the largest slack of each group (`hub`, `top`), to which `near` sets are sure to link."""
    best = deltas.groupBy("grp").agg(F.max(F.struct("slack", "node")).alias("best"))
    best = stored(best.select("grp", F.col("best.slack").alias("top"), F.col("best.node").alias("hub")), "best")
    rated = deltas.drop("delta").join(dealt(best), "grp")
    return stored(rated.withColumn("near", F.expr("slack + top >= 0")), "rated")


def meetings(deltas: DataFrame, rare: DataFrame, rated: DataFrame, percent: int) -> DataFrame:
    """(one, two): sets of different components, not both near, that meet early enough in their differences to link; once for each n-gram.

    A pair is sought by the set of the smaller slack. `reach` is what the n-grams from one place on can add to the sum of the slacks.
    """
    next_ = stored(rated.where("NOT near").groupBy("grp").agg(F.max("slack").alias("next")), "next")
    needed = deltas.sparkSession.sparkContext.broadcast(key_bits(rare.select("g"), filter_bits(rare.count())))

    def keep(batch: pa.RecordBatch) -> dict:
        lists = batch.column("delta")
        ends = np.asarray(lists.offsets)
        grams = np.asarray(lists.values)[ends[0]: ends[-1]].view(np.uint64)
        rows = np.repeat(np.arange(len(lists)), np.diff(ends))
        held = passes(needed.value, grams)
        return {"grp": batch.column("grp"), "node": batch.column("node"), "delta": _lists(rows[held], grams[held], len(lists))}

    kept = arrow_map(deltas.select("grp", "node", "delta"), keep, "grp long, node long, delta array<long>")
    shared = kept.select("grp", "node", F.explode("delta").alias("g")).join(dealt(rare), ["grp", "g"])
    listed = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("sets", "g"))).alias("list")).join(dealt(rated), "node").join(dealt(next_), "grp")
    own = ["grp", "node", "root", "slack", "near", "top", "next"]
    places = listed.select(*own, F.size("list").alias("size"), F.posexplode("list"))
    reach = 2 * (100 + percent) * (F.col("size") - F.col("pos"))
    places = stored(places.select(*own, F.col("col.g").alias("g"), reach.alias("reach")), "places")
    needed.destroy()
    seeking = places.where("NOT near AND reach + slack + top >= 0").select("grp", "g", F.col("node").alias("one"), "root", "slack", "reach")
    sought = places.where("reach + slack + if(near, next, slack) >= 0").select(
        "grp", "g", F.col("node").alias("two"), F.col("root").alias("root_m"), F.col("slack").alias("slack_m"), F.col("reach").alias("reach_m"))
    once = "root <> root_m AND (slack < slack_m OR (slack = slack_m AND one < two)) AND least(reach, reach_m) + slack + slack_m >= 0"
    return seeking.join(dealt(sought), ["grp", "g"]).where(once).select("one", "two")


def group_links(deltas: DataFrame, rare: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect, within each group, all sets of different components that links connect."""
    rated = rate(deltas)
    sure = rated.where("near AND node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    pairs = stored(meetings(deltas, rare, rated, percent).distinct(), "met")
    of = lambda node, d, s: dealt(deltas.select(F.col("node").alias(node), F.col("delta").alias(d), F.col("slack").alias(s)))
    both = pairs.join(of("a", "d", "s"), pairs["one"] == F.col("a")).join(of("b", "e", "t"), pairs["two"] == F.col("b"))
    counted = both.where(2 * (100 + percent) * F.size(F.array_intersect("d", "e")) + F.col("s") + F.col("t") >= 0)
    return stored(sure.unionByName(counted.select("a", "b")), "group_links")


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, its own included)."""
    marked = stored(signed(docs, words, Classes(percent)), "signed")
    held = repeated_only(marked)
    near = linked(docs, central_pairs(held, percent), words, percent)
    roots = connected_components(near)
    more = group_links(*differences(docs, groups(held, roots), words, percent), percent)
    if not more.isEmpty():
        roots = connected_components(near.unionByName(more))
    rooted = held.select("sid", "node").join(dealt(roots), "node").select("sid", "root")
    texts = marked.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first")).join(dealt(rooted), "sid", "left")
    smallest = stored(texts.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("low")), "smallest")
    found = texts.join(dealt(smallest), "root", "left").select("sid", F.least("low", "first").alias("component_id"))
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return marked.join(dealt(found), "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
