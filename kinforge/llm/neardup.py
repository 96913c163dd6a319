"""Near-duplicate documents: banded MinHash candidates, odd sketches, verification on full shingle sets, components.

A document's set holds its distinct five-word shingles over lower-cased words; fewer words are one shingle; without
words it is empty and linked with nothing.  Documents with 100 * |A and B| >= 75 * |A or B| are linked.

Equal sets are one class from the start, so copies never meet as pairs.  BANDS x ROWS MinHash values give each class
BANDS bucket keys (a pair at similarity exactly 0.75 shares none with probability 2.5e-7, at 0.8 with 7e-10).  The MinHash samples are also folded
into a parity bitmap, the odd sketch; the population count of two bitmaps' XOR estimates high similarities, and pairs
estimated far below the threshold (more than six standard errors) are not verified.

Pairs are formed as stars: in every bucket one hub with each other member.  Members that are then still in another
component than some bucket-mate meet further hubs, picked anew each round.  What remains after STAR_ROUNDS goes through
an exact set join across components (``prefix_pairs``): two sets at the threshold share one of the rarest quarter of
their shingles at positions that leave enough overlap.  Pairs inside one component never meet.  So a group of thousands
of near copies costs as many pairs as members, texts that merely share a passage cost none, and of the pairs that share
a band no link between different texts is left out but for the sketch's error.

Rows with a null id take no part (component null, kept).  Rows that repeat an id are one document: its texts' links
join.  Only ``doc_id`` and ``text`` are read; other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .frames import map_batches, materialize, narrow, settle
from .textkit import LOWER, U64, Rolling, Words, mix, spans, string_buffers, text_blocks

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, SKETCH_BITS = 40, 4, 512
LEAST_ESTIMATE = 0.5
STAR_ROUNDS = 2
_rng = np.random.default_rng(6)
MULTIPLIERS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)
OFFSETS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, at: np.ndarray, hashing: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, concatenated, and the offsets."""
    data = LOWER[data]
    words = Words(data, at)
    n = words.counts
    many = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    size = np.minimum(n, SHINGLE)
    h = hashing.windows(hashing.words(data, words), spans(words.first[:-1], many), np.repeat(size, many))
    ends = np.cumsum(many)
    out = []
    for a, b in zip(ends - many, ends):
        own = np.sort(h[a:b])
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if b > a else own)
    lengths = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else h), np.concatenate(([0], np.cumsum(lengths)))


def set_classes(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128-bit hash of each set as bytes; sums of mixed elements, so it needs no order."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, 2), np.uint64)
    if len(full):
        out[full, 0] = np.add.reduceat(mix(sets ^ OFFSETS[0]), at[full])
        out[full, 1] = np.add.reduceat(mix(sets ^ OFFSETS[1]), at[full])
    return out


def minhashes(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of every set (all must be non-empty)."""
    out = np.empty((len(at) - 1, BANDS * ROWS), np.uint64)
    for j in range(BANDS * ROWS):
        out[:, j] = np.minimum.reduceat((sets ^ OFFSETS[j]) * MULTIPLIERS[j], at[:-1])
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(minima), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + minima[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
    return keys


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """Parity bitmaps of SKETCH_BITS: each (sample, minimum) flips one bit."""
    n = len(minima)
    bit = mix(minima * U64(0xD6E8FEB86659FD93) + np.arange(minima.shape[1], dtype=np.uint64)) % U64(SKETCH_BITS)
    flips = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + bit.astype(np.int64)).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the XOR population count of two sketches (arrays of longs)."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    ratio = F.greatest(F.lit(1.0) - 2.0 * differ / SKETCH_BITS, F.lit(1e-9))
    return F.lit(1.0) + F.lit(SKETCH_BITS / (4.0 * BANDS * ROWS)) * F.ln(ratio)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (16 bytes), bands, sketch of every row; the last three null for an empty set."""

    def kernel(batch: pa.RecordBatch):
        hashing = Rolling(6)
        for lo, hi, data, at in text_blocks(batch.column(1), 1 << 19):
            sets, ends = shingle_sets(data, at, hashing)
            n = np.diff(ends)
            full = np.flatnonzero(n)
            minima = minhashes(sets, ends[np.append(full, len(n))]) if len(full) else np.zeros((0, BANDS * ROWS), np.uint64)
            rows = np.full(hi - lo, -1)
            rows[full] = np.arange(len(full))
            take = pa.array(rows, mask=rows < 0)
            lists = lambda m, k: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(m).view(np.int64).ravel())).take(take)
            cls = set_classes(sets, ends)[full]
            blob = pa.array([x.tobytes() for x in cls], pa.binary()).take(take)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), blob, lists(band_keys(minima), BANDS), lists(odd_sketches(minima), SKETCH_BITS // 64)], names=["doc_id", "n_shingles", "class", "bands", "sketch"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), kernel, "doc_id long, n_shingles long, class binary, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, members): the sorted shingle hashes of the classes in ``wanted`` (class, rep), from rep's text."""
    text = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep").select("class", "text")

    def kernel(batch: pa.RecordBatch):
        hashing = Rolling(6)
        for lo, hi, data, at in text_blocks(batch.column(1), 1 << 19):
            sets, ends = shingle_sets(data, at, hashing)
            got = set_classes(sets, ends)
            wanted_ = batch.column(0).slice(lo, hi - lo)
            right = [i for i in range(hi - lo) if wanted_[i].as_py() == got[i].tobytes()]  # an id may have several texts
            yield pa.RecordBatch.from_arrays([wanted_.take(pa.array(right, pa.int64())), pa.array([sets[ends[i] : ends[i + 1]].tobytes() for i in right], pa.binary())], names=["class", "members"])

    return map_batches(text, kernel, "class binary, members binary")


def verify(pairs: DataFrame, n: int, sets: DataFrame) -> DataFrame:
    """The linked of ``pairs`` (a, b, a_class, b_class), on full sets; ``n``: at least the pairs and the sets, whichever are more."""
    b = sets.select(F.col("class").alias("b_class"), F.col("members").alias("b_set"))
    a = sets.select(F.col("class").alias("a_class"), F.col("members").alias("a_set"))

    def kernel(batch: pa.RecordBatch):
        columns = [string_buffers(batch.column(i)) for i in (2, 3)]
        keep = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(data[at[i] : at[i + 1]].tobytes(), np.uint64) for data, at in columns)
            both = np.sort(np.concatenate((x, y)))
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= PERCENT * (len(both) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    joined = narrow(pairs.join(b, "b_class"), 16 * n).join(a, "a_class").select("a", "b", "a_set", "b_set")
    return narrow(map_batches(joined, kernel, "a long, b long"), 16 * n).distinct()


def _promising(pairs: DataFrame, n: int, sketches: DataFrame) -> DataFrame:
    x = sketches.select(F.col("class").alias("a_class"), F.col("sketch").alias("a_sketch"))
    y = sketches.select(F.col("class").alias("b_class"), F.col("sketch").alias("b_sketch"))
    return narrow(pairs.join(x, "a_class"), n).join(y, "b_class").where(estimate(F.col("a_sketch"), F.col("b_sketch")) >= LEAST_ESTIMATE).select("a", "b", "a_class", "b_class")


def prefix_pairs(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs (a, b, a_class, b_class) of ``classes`` (class, rep, component) in different components that may be linked.

    Each set is ordered by (frequency among these sets, hash).  Linked sets x, y share a shingle among the first
    |x| - ceil(0.75 |x|) + 1 places of each, and at their first shared one, at places i and j, the rest suffices:
    min(|x| - i, |y| - j) + 1 >= 3/7 (|x| + |y|).
    """
    own = classes.withColumnRenamed("class", "set_id")

    def kernel(batch: pa.RecordBatch):
        blobs = batch.column(1)
        for lo in range(0, batch.num_rows, 64):
            got = [np.frombuffer(blobs[i].as_py(), np.int64) for i in range(lo, min(lo + 64, batch.num_rows))]
            n = np.array([len(x) for x in got])
            ids = batch.column(0).slice(lo, len(got)).take(pa.array(np.repeat(np.arange(len(got)), n)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got)), ids, pa.array(np.repeat(n, n).astype(np.int32))], names=["shingle", "set_id", "n"])

    elements = map_batches(sets.withColumnRenamed("class", "set_id").join(own.select("set_id"), "set_id").select("set_id", "members"), kernel, "shingle long, set_id binary, n int")
    several = elements.groupBy("shingle").agg(F.count("*").alias("f")).where("f > 1")
    ranked = elements.join(several, "shingle").withColumn("k", F.row_number().over(Window.partitionBy("set_id").orderBy("f", "shingle"))).withColumn("m", F.count("*").over(Window.partitionBy("set_id")))
    place = ranked.withColumn("i", F.col("n") - F.col("m") + F.col("k"))  # the unshared come first
    prefix = materialize(place.where("i <= n - ceil(0.75 * n) + 1").select("shingle", "set_id", "n", (F.col("n") - F.col("i") + 1).alias("rest")))
    smallest = prefix.groupBy("shingle").agg(F.min("n").alias("least"), F.count("*").alias("held")).where("held > 1")
    prefix = prefix.join(smallest, "shingle").where("7 * rest >= 3 * (n + least)").select("shingle", "set_id", "n", "rest")
    x = prefix.join(own.select("set_id", "component"), "set_id")
    y = x.select("shingle", *[F.col(c).alias(f"y_{c}") for c in ("set_id", "n", "rest", "component")])
    near = x.join(y, "shingle").where("component < y_component and 7 * least(rest, y_rest) >= 3 * (n + y_n)").select("set_id", "y_set_id").distinct()
    a = own.select("set_id", F.col("rep").alias("a"), F.col("set_id").alias("a_class"))
    b = own.select(F.col("set_id").alias("y_set_id"), F.col("rep").alias("b"), F.col("set_id").alias("b_class"))
    return near.join(a, "set_id").join(b, "y_set_id").select("a", "b", "a_class", "b_class")


def near_duplicates(docs: DataFrame, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    signed, n = settle(signatures(docs))
    real = signed.where(F.col("doc_id").isNotNull() & F.col("class").isNotNull())
    classes, n_classes = settle(real.groupBy("class").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sketch", "doc_id").alias("sketch")), n)
    places = classes.select("rep", F.explode("bands").alias("bucket"))  # of narrow rows; the classes of one id are linked anyway
    crowded = narrow(places.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most").select("bucket"), n_classes * BANDS)
    places, m = settle(places.join(crowded, "bucket"), n_classes * BANDS)  # of buckets that hold two classes or more
    members = narrow(places.join(classes.select("class", "rep"), "rep"), m).select("class", "rep", "bucket")
    wanted = narrow(members.select("class", "rep").distinct(), n_classes)
    sketches, n_wanted = settle(classes.join(wanted.select("class"), "class", "left_semi").select("class", "rep", "sketch"), n_classes)
    sets = materialize(full_sets(docs, sketches.select("class", "rep")))

    several = narrow(real.groupBy("doc_id").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select("doc_id"), n)
    owned = narrow(real.select("doc_id", "class").join(several, "doc_id"), n).join(classes.select("class", "rep"), "class")
    links, n_links = settle(owned.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), n)  # the texts of a repeated id
    done, found = None, None
    for k in range(star_rounds + 1):
        left, size = settle(members, m) if found is None else settle(_unsettled(members, m, found), m)
        members = left if found is None else members
        if not size:
            break
        if k < star_rounds:
            pick = F.xxhash64("rep", F.lit(k)) if k else F.col("rep")  # at first the smallest id, then any
            hub = narrow(left.groupBy("bucket").agg(F.min(F.struct(pick.alias("pick"), *left.drop("bucket").columns)).alias("h")), size)
            pairs = narrow(left.join(hub, "bucket"), size).where(F.col("class") != F.col("h.class"))
            pairs = pairs if found is None else pairs.where(F.col("component") != F.col("h.component"))
            pairs = pairs.select(F.col("h.rep").alias("a"), F.col("rep").alias("b"), F.col("h.class").alias("a_class"), F.col("class").alias("b_class"))
        else:
            pairs = prefix_pairs(narrow(left.select("class", "rep", "component").distinct(), min(size, n_wanted)), sets)
        flip = F.col("a_class") > F.col("b_class")
        pairs = pairs.select(*[F.when(flip, F.col(f"{y}{s}")).otherwise(F.col(f"{x}{s}")).alias(f"{x}{s}") for x, y in ("ab", "ba") for s in ("", "_class")]).distinct()
        pairs, n_pairs = settle(pairs, size if k < star_rounds else None)
        if done is not None:
            pairs = narrow(pairs.join(done, ["a_class", "b_class"], "left_anti").select("a", "b", "a_class", "b_class"), n_pairs)
        pairs, n_pairs = settle(_promising(pairs, max(n_pairs, n_wanted), sketches), n_pairs)
        fresh, n_fresh = settle(verify(pairs, max(n_pairs, n_wanted), sets), n_pairs)
        done = pairs.select("a_class", "b_class") if done is None else done.unionAll(pairs.select("a_class", "b_class"))
        if n_fresh or found is None:
            links = links.unionAll(fresh)
            found = components(links)
    component = found[0].withColumnRenamed("node", "rep") if found else links.select(F.col("a").alias("rep"), F.col("a").alias("component")).limit(0)
    known = narrow(classes.select("class", "rep").join(component, "rep", "left"), n_classes).select("class", F.coalesce("component", "rep").alias("of_class"))
    result = signed.select("doc_id", "n_shingles", "class").join(known, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _unsettled(members: DataFrame, m: int, found: tuple[DataFrame, int]) -> DataFrame:
    """Members, with components, of the buckets that still hold several components."""
    labelled = narrow(members.join(found[0].withColumnRenamed("node", "rep"), "rep", "left"), m).withColumn("component", F.coalesce("component", "rep"))
    mixed = narrow(labelled.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("bucket"), m)
    return labelled.join(mixed, "bucket")


def near_duplicates_in_memory(rows: list[tuple]) -> list[tuple]:
    """Brute force over (doc_id, text): (doc_id, n_shingles, component_id, kept).  For tests."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(w[i : i + SHINGLE]) for i in range(max(len(w) - SHINGLE + 1, min(len(w), 1)))})
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        common: dict = {}
        for x in s:
            for j in holders[x]:
                if j < i and rows[j][0] is not None:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= PERCENT * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                root[b] = a
    return [(d, len(s), find(d) if d is not None and s else d, d is None or not s or find(d) == d) for (d, _), s in zip(rows, sets)]
