"""Benchmark decontamination with one FM-index per shard of training documents.

A shard is a block of whole documents inside a task.  Its words are numbered by the benchmark vocabulary and reduced
to the runs in which every neighbouring pair of words is also a pair of some benchmark item: no window can occur
outside such a run, so the index stays small and the result whole.  Over the runs the kernel builds a suffix array
by prefix doubling, the Burrows-Wheeler transform, a wavelet matrix for ranks, and suffix positions sampled at every
SAMPLE-th place and at each run's head.  All windows of all items are searched backwards together; occurrences are
located by walking to a sampled position, and their word spans are merged per document.

A window is 13 consecutive words of an item; an item of fewer words, but not none, is one window.  Items are taken in
blocks of at most ITEM_BYTES, one pass over the documents for each block, so what a task holds stays bounded however
large the benchmark is; spans and items of earlier passes are carried along.

A null or empty text has no words and is never contaminated.  Items with a null id or without words take no part;
repeated item ids are one item.  Rows with null or repeated doc ids are judged row by row.  Only ``doc_id``, ``text``
and ``item_id``, ``text`` are read; other columns may have any name and are carried only in ``row``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_batches
from .textkit import ALNUM, LOWER, U64, Rolling, Words, covered, runs, spans, string_buffers, text_blocks

WINDOW, SAMPLE = 13, 8
BLOCK_BYTES = 2 << 20
ITEM_BYTES = 8 << 20
SEED = 4


@dataclass(frozen=True)
class Phrases:
    """Windows of a block of items, over word numbers from 1."""

    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place + 1
    pairs: np.ndarray  # sorted, first * (V + 1) + second
    windows: tuple  # of (length, matrix of word numbers)
    bounds: np.ndarray  # the holders of window i, in that order, are holders[bounds[i]:bounds[i + 1]]
    holders: np.ndarray  # item numbers
    names: tuple  # item ids as strings, sorted


def phrases(ids: list[str], texts: list[str]) -> Phrases:
    """Distinct windows of the items and who holds each."""
    data, at = string_buffers(pa.array(texts, pa.large_string()))
    data = LOWER[data]
    words = Words(data, at, ALNUM)
    hashes = Rolling(SEED).words(data, words)
    vocabulary, number = np.unique(hashes, return_inverse=True)
    number += 1
    names = sorted(set(ids))
    place = {x: i for i, x in enumerate(names)}
    same = words.row[1:] == words.row[:-1] if len(words) else np.zeros(0, bool)
    pairs = np.unique(number[:-1][same] * (len(vocabulary) + 1) + number[1:][same]) if len(words) else np.zeros(0, np.int64)
    item, number = np.array([place[x] for x in ids], np.int64), number.astype(np.int32)
    size = np.minimum(words.counts, WINDOW).astype(np.int64)
    windows, bounds, holders = [], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(size[size > 0]).tolist():
        own = np.flatnonzero(size == n)
        many = words.counts[own].astype(np.int64) - n + 1
        rows = number[spans(words.first[own], many)[:, None] + np.arange(n)]
        key = rows.view(f"V{4 * n}").ravel()
        order = np.argsort(key, kind="stable")  # by their bytes
        rows, new = rows[order], np.ones(len(order), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(1)
        held = np.unique((np.cumsum(new) - 1) * len(names) + np.repeat(item[own], many)[order])
        windows.append((n, rows[new]))
        holders.append(held % len(names))
        bounds.append(bounds[-1][-1] + np.cumsum(np.bincount(held // len(names))))
    return Phrases(vocabulary, pairs, tuple(windows), np.concatenate(bounds), np.concatenate(holders).astype(np.int32), tuple(names))


class FMIndex:
    """Self-index of runs of numbers; runs end in a 0 that no pattern holds."""

    def __init__(self, text: np.ndarray, alphabet: int):
        n = len(text)
        self.array = self._suffixes(text)
        self.bwt = text[self.array - 1]
        counts = np.bincount(text, minlength=alphabet + 1)
        self.before = np.concatenate(([0], np.cumsum(counts)))[: alphabet + 1]
        self.levels = max(1, int(alphabet).bit_length())
        self.ones, self.zeros, order = [], [], self.bwt
        for level in range(self.levels - 1, -1, -1):  # wavelet matrix: stable partition by each bit
            bit = (order >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(n - int(bit.sum()))
            order = np.concatenate((order[bit == 0], order[bit == 1]))
        head = np.ones(n, bool)
        head[1:] = text[:-1] == 0
        kept = head[self.array] | (self.array % SAMPLE == 0)
        self.sample = np.where(kept, self.array, -1)
        del self.array

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling; every 0 is a symbol of its own, ordered by place."""
        n = len(text)
        ends = text == 0
        rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
        step = 1
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * (int(rank.max()) + n + 2) + ahead
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            step *= 2
            if fresh[-1] == n - 1 or step >= n:
                return order

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the first ``upto`` places of the transform."""
        at, base = upto, np.zeros_like(upto)
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (self.levels - 1 - i)) & 1).astype(bool)
            a, b = ones[at], ones[base]
            at, base = np.where(bit, zeros + a, at - a), np.where(bit, zeros + b, base - b)
        return at - base

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of all patterns of one length, matched from their last symbol backwards."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for i in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, i].astype(np.int64)
            lo[live] = self.before[c] + self.rank(c, lo[live])
            hi[live] = self.before[c] + self.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row, stepping back to a sampled one."""
        out, at = np.empty(len(rows), np.int64), rows.copy()
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            got = self.sample[at[open_]]
            found = got >= 0
            out[open_[found]] = got[found] + steps
            open_ = open_[~found]
            c = self.bwt[at[open_]].astype(np.int64)
            at[open_] = self.before[c] + self.rank(c, at[open_])
            steps += 1
        return out


def reduce_words(number: np.ndarray, first: np.ndarray, wanted: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Runs that may hold a window, each followed by a 0, and the word index of every place (-1 at a 0)."""
    n = len(number)
    if not n or not wanted.windows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = number[:-1] * (len(wanted.vocabulary) + 1) + number[1:]
    linked = np.zeros(n, bool)  # to the word before
    if len(wanted.pairs):
        near = np.minimum(np.searchsorted(wanted.pairs, key), len(wanted.pairs) - 1)
        linked[1:] = (wanted.pairs[near] == key) & (number[:-1] > 0) & (number[1:] > 0)
    linked[first[:-1][np.diff(first) > 0]] = False
    begin = np.flatnonzero(~linked & (number > 0))
    brk = np.flatnonzero(~linked)
    length = np.diff(np.append(brk, n))[np.searchsorted(brk, begin)]
    keep = length >= min(size for size, _ in wanted.windows)
    begin, length = begin[keep], length[keep]
    places = spans(begin, length + 1)
    last = np.cumsum(length + 1) - 1
    places[last] = -1
    text = np.where(places >= 0, number[places], 0)
    return text, places


def find_windows(number: np.ndarray, first: np.ndarray, wanted: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, window) of every occurrence in a shard."""
    text, places = reduce_words(number, first, wanted)
    if not len(text):
        return (np.zeros(0, np.int64),) * 3
    index = FMIndex(text, len(wanted.vocabulary))
    at, size, which, base = [], [], [], 0
    for length, patterns in wanted.windows:
        lo, hi = index.search(patterns)
        rows = spans(lo, hi - lo)
        at.append(places[index.locate(rows)])
        size.append(np.full(len(rows), length))
        which.append(base + np.repeat(np.arange(len(patterns)), hi - lo))
        base += len(patterns)
    return np.concatenate(at), np.concatenate(size), np.concatenate(which)


def _merge(mask: np.ndarray) -> np.ndarray:
    """Alternating starts and ends of the True runs."""
    return np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))


def mark_contamination(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, [row,] n_words, spans (word starts and ends, alternating, merged) and items (sorted ids)."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")] if others else []))
    empty = lambda kind: F.array().cast(kind)
    frame = frame.select("*", F.lit(0).cast("long").alias("n_words"), empty("array<int>").alias("spans"), empty("array<string>").alias("items"))
    schema = T.StructType(list(frame.schema.fields))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("body")).where(F.col("item").isNotNull() & F.col("body").isNotNull())
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = 1 + int(total) // item_bytes
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k).orderBy("item", "body").collect()  # bounded by item_bytes
        frame = _pass(frame, phrases([r["item"] for r in own], [r["body"] for r in own]), schema, block_bytes)
    return frame


def _pass(frame: DataFrame, wanted: Phrases, schema: T.StructType, block_bytes: int) -> DataFrame:
    text_at = frame.columns.index("text")

    def kernel(batch: pa.RecordBatch):
        hashing = Rolling(SEED)
        for lo, hi, data, at in text_blocks(batch.column(text_at), block_bytes):
            data = LOWER[data]
            words = Words(data, at, ALNUM)
            number = np.zeros(len(words), np.int64)
            if len(words) and len(wanted.vocabulary):
                h = hashing.words(data, words)
                near = np.minimum(np.searchsorted(wanted.vocabulary, h), len(wanted.vocabulary) - 1)
                number = np.where(wanted.vocabulary[near] == h, near + 1, 0)
            start, size, which = find_windows(number, words.first, wanted)
            own = batch.slice(lo, hi - lo)
            before_spans, before_items = own.column("spans").to_pylist(), own.column("items").to_pylist()
            mask = np.zeros(len(words), bool)
            for long in np.unique(size):
                mask |= covered(start[size == long], int(long), len(words))
            hit_rows = np.unique(words.row[start]) if len(start) else []
            seen = np.unique(words.row[start] * len(wanted.bounds) + which) if len(start) else np.zeros(0, np.int64)
            row, window = np.divmod(seen, len(wanted.bounds))
            many = wanted.bounds[window + 1] - wanted.bounds[window]
            held = np.unique(np.repeat(row, many) * len(wanted.names) + wanted.holders[spans(wanted.bounds[window], many)])
            row, item = np.divmod(held, max(len(wanted.names), 1))
            for r in hit_rows:
                a, b = words.first[r], words.first[r + 1]
                full = mask[a:b].copy()
                for x, y in zip(before_spans[r][::2], before_spans[r][1::2]):
                    full[x:y] = True
                before_spans[r] = _merge(full).tolist()
                before_items[r] = sorted(set(before_items[r]) | {wanted.names[i] for i in item[slice(*np.searchsorted(row, (r, r + 1)))]})
            new = {"n_words": pa.array(words.counts.astype(np.int64)), "spans": pa.array(before_spans, pa.list_(pa.int32())), "items": pa.array(before_items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, own.column(c)) for c in own.schema.names], names=own.schema.names)

    return map_batches(frame, kernel, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """mark_contamination and n_hit, n_items, contaminated: words of any occurrence are a twentieth of all or more."""
    got = mark_contamination(docs, benchmark, **options)
    ends = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.when((i % 2 == 1) & (i < F.size("spans")), F.get("spans", i) - F.get("spans", i - 1)).otherwise(0))
    got = got.withColumn("n_hit", F.aggregate(ends, F.lit(0).cast("long"), lambda a, x: a + x)).withColumn("n_items", F.size("items").cast("long"))
    return got.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination_in_memory(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """Brute force: (doc_id, n_words, n_hit, n_items, items joined, contaminated).  For tests."""
    import re

    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(pattern, (t or "").translate(lower))
    windows: dict = {}
    for item, text in items:
        w = split(text)
        for i in range(max(len(w) - WINDOW + 1, min(len(w), 1))):
            if item is not None:
                windows.setdefault(tuple(w[i : i + WINDOW]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, got = split(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    got |= windows[key]
        out.append((doc, len(w), len(hit), len(got), ",".join(sorted(got)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out
