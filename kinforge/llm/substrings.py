"""Substring dedup with difference-cover anchors.

A window is WINDOW consecutive words.  Hashes of PERIOD-sized anchors are taken only at word positions whose residue
modulo the period lies in a difference cover ({0, 1, 3} modulo 7: every difference of two positions is a difference of
two members), so two equal windows, wherever they start, share an anchor at the same offset inside both.  An anchor
that two documents hold is extended to every window around it; only those windows are compared, by 128 bits of two other
hash families over the 64-bit hashes of their words, and each learns the smallest document that holds it.  A word covered
by a window that a smaller document also holds goes.

Both rounds go through packed questions of distinct keys (see ``shards``), so neither a passage in a third of all
documents nor a group of thousands of copies meets in one task, and no pairs are formed.

A null text has no words.  A row with a null id takes no part: it keeps its words and removes none elsewhere.  Rows
that repeat an id are one document and do not remove each other's words; windows that repeat inside one document stay.
Extra columns come back in ``row``, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import shards as sh
from .textkit import NOT_SPACE, U64, Rolling, Words, covered, mix, order_of, runs, spans, text_blocks, window_starts

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1


def _anchors(words: Words, hashes: np.ndarray, hashing: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of the anchors at cover positions."""
    starts, row = window_starts(words.first, ANCHOR)
    member = np.zeros(PERIOD, bool)
    member[list(COVER)] = True
    keep = member[(starts - words.first[row]) % PERIOD] & (words.counts[row] >= WINDOW)
    starts = starts[keep]
    return starts, hashing.windows(hashes, starts, ANCHOR)


class _Shard:
    """One shard's blocks; ids of null rows are masked out."""

    def __init__(self, docs: pa.Table):
        ids = sh.one(docs, "doc_id")
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = sh.one(docs, "text")
        self.rolling = Rolling(10), Rolling(11), Rolling(12)

    def blocks(self):
        for lo, hi, data, at in text_blocks(self.text):
            words = Words(data, at, NOT_SPACE)
            yield lo, hi, data, words, self.rolling[0].words(data, words)

    def anchors(self):
        """Distinct hashes, ascending, whether two documents here hold each, and per block its anchors' starts and places among them."""
        starts, codes, ids, cuts = [], [], [], [0]
        for lo, _, _, words, hashes in self.blocks():
            s, c = _anchors(words, hashes, self.rolling[0])
            known = self.known[lo + words.row[s]]
            starts.append(s[known])
            codes.append(c[known])
            ids.append(self.ids[lo + words.row[s[known]]])
            cuts.append(cuts[-1] + int(known.sum()))
        code, doc = (np.concatenate(codes), np.concatenate(ids)) if codes else (np.zeros(0, U64), np.zeros(0, np.int64))
        order = order_of(code)
        begin, length = runs(code[order])
        doc = doc[order]
        several = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin) if len(begin) else np.zeros(0, bool)
        place = np.empty(len(code), np.int64)
        place[order] = np.repeat(np.arange(len(begin)), length)
        return code[order][begin], several, [(s, place[a:b]) for s, a, b in zip(starts, cuts, cuts[1:])]

    def windows(self, shared: np.ndarray, per_block: list):
        """Per block: windows around shared anchors as (start word, two hashes, row of the shard)."""
        for (lo, _, data, words, hashes), (starts, place) in zip(self.blocks(), per_block):
            hit = starts[shared[place]]
            first = words.first[words.row[hit]] if len(hit) else hit
            left = np.maximum(hit - PERIOD + 1, first)
            mark = covered(left, hit - left + 1, len(words))
            at = np.flatnonzero(mark)
            at = at[at + WINDOW <= words.first[words.row[at] + 1]] if len(at) else at
            other = self.rolling[1].words(data, words) if len(at) else hashes
            yield data, words, at, self.rolling[1].windows(other, at, WINDOW), self.rolling[2].windows(mix(other ^ U64(OTHER)), at, WINDOW), lo + words.row[at]


OTHER = 0x9E3779B97F4A7C15


def _order(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by the first key, and by all of them where that ties; first places and lengths of the runs of equal keys."""
    order = order_of(keys[0])
    sorted_ = [k[order] for k in keys]
    tied = sorted_[0][1:] == sorted_[0][:-1]
    if any((tied & (k[1:] != k[:-1])).any() for k in sorted_[1:]):
        order = np.lexsort(keys[::-1])
        sorted_ = [k[order] for k in keys]
    fresh = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in sorted_], axis=0))) if len(order) else np.zeros(0, bool)
    begin = np.flatnonzero(fresh)
    return order, begin, np.diff(np.append(begin, len(order)))


def remove_repeats(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """doc_id, text, [row,] n_words, n_removed, kept_text (kept words joined by one space) for every row."""
    dealt, _, parts = sh.deal(docs, shards)

    def part_of(h: np.ndarray) -> np.ndarray:
        return (h >> U64(32)) * U64(parts) >> U64(32)  # equal ranges of the hash: keys sorted by hash are sorted by part

    def ask_anchors(docs_: pa.Table) -> pa.Table:
        code, several, _ = _Shard(docs_).anchors()
        low = code.astype(np.uint32)  # with the part about 32 bits and the logarithm of the parts; a false meeting only adds a candidate
        return sh.questions(docs_.column("shard")[0].as_py(), part_of(code), lambda a, b: low[a:b].tobytes(), lambda a, b: np.packbits(several[a:b]).tobytes())

    def answer_anchors(asked: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), np.uint32) for x in asked.column("keys")]
        several = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(k)) for x, k in zip(asked.column("values"), keys)])
        cuts, keys = sh.pieces([len(k) for k in keys]), np.concatenate(keys)
        order = (np.sort(keys.astype(np.uint64) << U64(32) | np.arange(len(keys), dtype=np.uint64)) & U64(0xFFFFFFFF)).astype(np.int64)
        begin, length = runs(keys[order])
        shared = np.empty(len(keys), bool)
        shared[order] = np.repeat((length > 1) | (np.add.reduceat(several[order].astype(np.int64), begin) > 0), length)
        return sh.answers(asked, 1, [np.packbits(shared[a:b]).tobytes() for a, b in cuts])

    def candidates(docs_: pa.Table, replies: pa.Table):
        own = _Shard(docs_)
        code, _, per_block = own.anchors()
        found = list(own.windows(sh.bits_in_order(replies, 1, part_of(code)), per_block))
        h, g, row = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, kind) for i, kind in ((3, U64), (4, U64), (5, np.int64)))
        order, begin, length = _order(h, g)
        place = np.empty(len(h), np.int64)
        place[order] = np.repeat(np.arange(len(begin)), length)
        least = np.minimum.reduceat(own.ids[row][order], begin) if len(begin) else np.zeros(0, np.int64)
        return own, found, row, h[order][begin], g[order][begin], least, place

    def ask_windows(docs_: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return sh.questions(0, np.zeros(0, U64), bytes, bytes)
        _, _, _, h, g, least, _ = candidates(docs_, replies)
        return sh.questions(docs_.column("shard")[0].as_py(), part_of(h), lambda a, b: h[a:b].tobytes() + g[a:b].tobytes(), lambda a, b: sh.pack(least[a:b]))

    def answer_windows(asked: pa.Table) -> pa.Table:
        pairs = [np.frombuffer(x.as_py(), np.uint64).reshape(2, -1) for x in asked.column("keys")]
        least = np.concatenate([sh.unpacked(x.as_py(), np.int64) for x in asked.column("values")])
        cuts = sh.pieces([x.shape[1] for x in pairs])
        order, begin, length = _order(*np.concatenate(pairs, axis=1))
        earlier = np.empty(len(least), bool)
        earlier[order] = np.repeat(np.minimum.reduceat(least[order], begin), length) < least[order]
        return sh.answers(asked, 2, [np.packbits(earlier[a:b]).tobytes() for a, b in cuts])

    def finish(docs_: pa.Table, replies: pa.Table) -> pa.Table:
        own, found, row, h, _, least, place = candidates(docs_, replies)
        gone = sh.bits_in_order(replies, 2, part_of(h))[place] | (own.ids[row] > least[place])
        n_words, n_removed, kept, done = [], [], [], 0
        for data, words, at, *_ in found:
            cut = covered(at[gone[done : done + len(at)]], WINDOW, len(words))
            done += len(at)
            n_words.append(words.counts)
            n_removed.append(np.diff(np.concatenate(([0], np.cumsum(cut)))[words.first]))
            kept += kept_texts(data, words, ~cut)
        out = {c: docs_.column(c) for c in docs_.column_names if c != "shard"}
        counts = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table(out | {"n_words": counts(n_words), "n_removed": counts(n_removed), "kept_text": pa.array(kept, pa.string())})

    first = sh.ask(dealt, ask_anchors, answer_anchors)
    second = sh.answer(sh.meet(dealt, first, ask_windows, sh.QUESTION), answer_windows)
    schema = T.StructType([*(f for f in dealt.schema.fields if f.name != "shard"), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return sh.meet(dealt, first.unionAll(second), finish, schema)


def kept_texts(data: np.ndarray, words: Words, keep: np.ndarray) -> list[bytes]:
    """Per row its kept words, joined by one space."""
    starts, lengths = words.starts[keep], words.ends[keep] - words.starts[keep] + 1
    padded = np.append(data, np.uint8(0x20))
    joined = padded[spans(starts, lengths)]
    ends = np.cumsum(lengths)
    joined[ends - 1] = 0x20
    first = np.concatenate(([0], np.cumsum(keep)))[words.first]
    at = np.concatenate(([0], ends))[first]
    blob = joined.tobytes()
    return [blob[a : max(a, b - 1)] for a, b in zip(at, at[1:])]


def remove_repeats_in_memory(rows: list[tuple]) -> list[tuple]:
    """Brute force over (doc_id, text): (doc_id, n_words, n_removed, kept_sha256).  For tests."""
    import re

    split = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    least: dict = {}
    for (doc, _), words in zip(rows, split):
        for i in range(len(words) - WINDOW + 1):
            if doc is not None:
                key = tuple(words[i : i + WINDOW])
                least[key] = min(least.get(key, doc), doc)
    out = []
    for (doc, _), words in zip(rows, split):
        gone = set()
        for i in range(len(words) - WINDOW + 1):
            if doc is not None and least[tuple(words[i : i + WINDOW])] < doc:
                gone.update(range(i, i + WINDOW))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
