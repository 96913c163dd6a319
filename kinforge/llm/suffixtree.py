"""LM scoring with a probabilistic suffix tree, beside a unigram base.

Tokens are the lower-cased words of a text and one end.  The tree predicts the text byte by byte: every word's bytes,
then a blank if a word follows and the end mark if not, so its probabilities are over the same token sequences as the
base's.  Contexts of up to LONG bytes (with their symbol, one 64-bit number) are counted over the whole training part of
the corpus.  A context is a candidate if it is seen LEAST times, whatever the size of the corpus, and is kept if its
next-symbol counts diverge from its parent's: N * KL >= DIVERGENCE nats; the suffixes of kept contexts stay too, and
contexts of up to SHORT bytes always do.  So the number of states grows with the corpus.  Distributions are smoothed
along the path of suffixes (Witten-Bell) down to a uniform root.  A symbol is scored in the longest suffix state of what
precedes it.

No worker holds the tree.  Contexts longer than SHORT bytes live in the hash part of their last SHORT + 1 bytes, with all
their suffixes down to that length; shards ask these parts for the scores of their distinct grams and bring the counts
along (see ``shards``).  Only contexts of up to SHORT bytes are broadcast: their number is limited by the alphabet.

The base needs the count of every token of every text: shards ask hash parts for the counts of their distinct tokens
(see ``shards``), so the vocabulary is never in one place and a frequent word is one key per shard.

Null and empty texts are the end alone.  A null id is scored, not learned from and not held out.  Repeated rows count
and score each.  Without training texts the tree is uniform over bytes.  Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shards as sh
from .frames import fold, relax
from .textkit import LOWER, U64, Rolling, Words, by_row, mix, order_of, runs, spans, text_blocks

DEPTH, LONG, SHORT, LEAST, DIVERGENCE = 5, 7, 3, 3, 8.0  # DEPTH: of the in-memory functions, if not said
BLANK, END = 0x20, 0x0A
SHARD_BYTES, BLOCK_BYTES, SYMBOLS = 10 << 20, 1 << 20, 2 << 20  # grams repeat more in a larger shard
END_TOKEN = int(mix(np.array([1], np.uint64))[0])


def grams(data: np.ndarray, words: Words, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Per symbol of every text: the ``depth`` bytes (7 at most) before it and itself as a number, and its row.  ``data`` is lower-cased."""
    n = len(words.counts)
    length = words.ends - words.starts + 1
    size = by_row(words.row, n, length.astype(float)).astype(np.int64)
    size = np.where(words.counts == 0, 1, size) + depth
    ends = np.cumsum(size)
    stream = np.full(int(ends[-1]) if n else 0, END, np.uint8)
    within = np.cumsum(length) - length
    before = np.concatenate(([0], within, [length.sum()]))[np.minimum(words.first[:-1] + 1, len(length) + 1)] if len(length) else np.zeros(n, np.int64)
    to = (ends - size + depth)[words.row] + within - before[words.row] if len(length) else within
    place = spans(to, length)
    source = spans(words.starts, length)
    source[np.cumsum(length) - 1] = 0
    stream[place] = data[source] if len(data) else stream[place]
    last = np.cumsum(length) - 1
    stream[place[last]] = BLANK
    stream[ends - 1] = END
    padded = np.concatenate((np.zeros(7, np.uint8), stream))
    code = np.ndarray(len(stream), "<u8", padded, 0, (1,)).byteswap() & U64((1 << 8 * (depth + 1)) - 1)  # eight bytes up to each
    row = np.repeat(np.arange(n), size)
    real = np.arange(len(stream)) >= np.repeat(ends - size + depth, size)
    return code[real], row[real]


def count_grams(docs: DataFrame, modulus: int, held_out: int, depth: int) -> DataFrame:
    """(code, n): counts of all grams of the training texts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, at in text_blocks(batch.column(0), BLOCK_BYTES):
                data = LOWER[data]
                got = np.sort(grams(data, Words(data, at), depth)[0])
                first, n = runs(got)
                codes, counts = add_up(np.concatenate((codes, got[first])), np.concatenate((counts, n)))
        for a in range(0, len(codes), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(codes[a : a + (1 << 18)].view(np.int64)), pa.array(counts[a : a + (1 << 18)])], names=["code", "n"])

    learned = docs.where(fold("doc_id", modulus) != held_out).select("text")
    return learned.mapInArrow(kernel, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def add_up(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the sums of their counts."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes)
    codes = codes[order]
    begin, _ = runs(codes)
    return codes[begin], np.add.reduceat(counts[order], begin)


def add_up_runs(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of several ascending lists of distinct keys: all distinct keys, the sums of their counts, and each list's places."""
    every = np.sort(np.concatenate(keys))
    every = every[runs(every)[0]]
    total, places = np.zeros(len(every), np.int64), []
    for k, n in zip(keys, counts):
        places.append(np.searchsorted(every, k))
        total[places[-1]] += n
    return every, total, places


def candidates(codes: np.ndarray, counts: np.ndarray, depths: Iterable[int]) -> tuple[np.ndarray, ...]:
    """(depth, context, symbol, n), sorted, of the contexts of these depths (ascending) seen LEAST times or more."""
    out = [(np.zeros(0, np.int64),) * 4]
    for depth in depths:
        gram, n = add_up(codes & U64((1 << 8 * (depth + 1)) - 1), counts)
        begin, length = runs(gram >> U64(8))
        alive = np.repeat(np.add.reduceat(n, begin) >= LEAST, length) if len(begin) else np.zeros(0, bool)
        gram, n = gram[alive], n[alive]
        out.append((np.full(len(gram), depth), (gram >> U64(8)).astype(np.int64), (gram & U64(255)).astype(np.int64), n))
    return tuple(np.concatenate(x) for x in zip(*out))


def collected(docs: DataFrame, modulus: int, held_out: int, depth: int) -> tuple[np.ndarray, ...]:
    got = count_grams(docs, modulus, held_out, depth).toArrow()
    codes, counts = add_up(got.column("code").to_numpy().astype(np.int64).view(np.uint64), got.column("n").to_numpy().astype(np.int64))
    return candidates(codes, counts, range(depth + 1))


def fit_tree(docs: DataFrame, modulus: int = 10, held_out: int = 0, depth: int = LONG) -> dict[str, np.ndarray]:
    """The whole tree in one process.  For tests."""
    return grow(*collected(docs, modulus, held_out, depth))


def grow(d: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, ordered: bool = False) -> dict[str, np.ndarray]:
    """Arrays of the kept states: per depth sorted contexts; per state its parent, escape weight; sorted (state, symbol) probabilities."""
    if not len(d):
        d, context, symbol, n = (np.zeros(1, np.int64),) * 3 + (np.ones(1, np.int64) * 0,)
    if not ordered:
        order = np.lexsort((symbol, context, d))
        d, context, symbol, n = d[order], context[order], symbol[order], n[order]
    begin, length = runs(d << 56 | context)
    depth, name = d[begin], context[begin]
    total = np.add.reduceat(n, begin)
    state = np.repeat(np.arange(len(begin)), length)
    key = depth << 56 | name
    suffix = np.where(depth > 0, (depth - 1) << 56 | (name & ((1 << 8 * np.maximum(depth - 1, 0)) - 1)), 0)
    parent = np.searchsorted(key, suffix)  # a suffix is at least as frequent, so it is a candidate too
    pair = state << 8 | symbol
    up = np.searchsorted(pair, parent[state] << 8 | symbol)
    p, q = n / np.maximum(total[state], 1), n[np.minimum(up, len(n) - 1)] / np.maximum(total[parent[state]], 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.add.reduceat(np.where(n > 0, n * np.log(np.maximum(p, 1e-300) / np.maximum(q, 1e-300)), 0), begin)
    keep = (depth <= SHORT) | (gain >= DIVERGENCE)
    for level in range(LONG, 0, -1):
        keep[parent[keep & (depth == level)]] = True
    kept = np.cumsum(keep) - 1
    seen = keep[state]
    distinct = length.astype(float)
    escape = np.where(total > 0, distinct / (total + distinct), 1.0)
    probability = np.zeros(len(n))
    for level in range(LONG + 1):  # the parent's smoothed value is known first
        own = depth[state] == level
        below = 1 / 256 if level == 0 else probability[up[own]]
        probability[own] = n[own] / (total + distinct)[state[own]] + escape[state[own]] * below
    return {"key": key[keep], "parent": kept[parent[keep]], "log_escape": np.log10(escape[keep]), "pair": kept[state[seen]] << 8 | symbol[seen], "log_p": np.log10(probability[seen])}


def log_probabilities(codes: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """log10 of each gram's last symbol in its longest suffix state."""
    codes = codes.astype(np.uint64)
    context, symbol = (codes >> U64(8)).astype(np.int64), (codes & U64(255)).astype(np.int64)
    state = np.zeros(len(codes), np.int64)
    open_ = np.arange(len(codes))
    for level in range(LONG, 0, -1):
        want = level << 56 | context[open_] & ((1 << 8 * level) - 1)
        at = np.minimum(np.searchsorted(model["key"], want), len(model["key"]) - 1)
        found = model["key"][at] == want
        state[open_[found]] = at[found]
        open_ = open_[~found]
    out = np.zeros(len(codes))
    open_ = np.arange(len(codes))
    while len(open_):
        want = state[open_] << 8 | symbol[open_]
        at = np.minimum(np.searchsorted(model["pair"], want), len(model["pair"]) - 1)
        found = model["pair"][at] == want
        out[open_[found]] += model["log_p"][at[found]]
        open_ = open_[~found]
        out[open_] += model["log_escape"][state[open_]]
        root = state[open_] == 0
        out[open_[root]] -= math.log10(256)
        open_ = open_[~root]
        state[open_] = model["parent"][state[open_]]
    return out


def tree_scores(data: np.ndarray, words: Words, model: dict[str, np.ndarray], depth: int = DEPTH) -> np.ndarray:
    """log10 probability of each text, from a whole tree.  For tests."""
    code, row = grams(data, words, depth)
    return by_row(row, len(words.counts), log_probabilities(code, model))


def differences(key: np.ndarray) -> bytes:
    return sh.pack(np.diff(key, prepend=U64(0)))


def from_differences(blob: bytes) -> np.ndarray:
    return np.cumsum(sh.unpacked(blob, np.uint64), dtype=np.uint64)


def score_lm(docs: DataFrame, modulus: int = 10, held_out: int = 0, shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    short = docs.sparkSession.sparkContext.broadcast(collected(docs, modulus, held_out, SHORT))
    dealt, _, parts = sh.deal(docs, shards, SHARD_BYTES)
    remainder = lambda ids: np.array([-1 if i is None else zlib.crc32(str(i).encode()) % modulus for i in ids.to_pylist()], np.int64)

    def tokens(docs_: pa.Table):
        """All tokens of the shard, ascending: order, row, and the distinct ones' places and lengths; the end is a token of every row."""
        hashing, hashes, rows = Rolling(5), [], []
        text = sh.one(docs_, "text")
        for lo, _, data, at in text_blocks(text, BLOCK_BYTES):
            data = LOWER[data]
            words = Words(data, at)
            hashes.append(hashing.words(data, words))
            rows.append((lo + words.row).astype(np.int32))
        n = len(text)
        h, row = np.concatenate([*hashes, np.full(n, END_TOKEN, np.uint64)]), np.concatenate([*rows, np.arange(n, dtype=np.int32)])
        order = order_of(h)
        h = h[order]
        begin, length = runs(h)
        return h[begin], row[order], begin, length

    def word_part(h: np.ndarray) -> np.ndarray:
        return (h >> U64(32)) * U64(parts) >> U64(32)  # equal ranges of the hash: sorted by hash is sorted by part

    def learning(docs_: pa.Table) -> np.ndarray:
        fold_ = remainder(sh.one(docs_, "doc_id"))
        return (fold_ >= 0) & (fold_ != held_out)

    def ask(docs_: pa.Table) -> pa.Table:
        key, row, begin, _ = tokens(docs_)
        n = np.add.reduceat(learning(docs_)[row].astype(np.int64), begin).astype(np.uint32)
        return sh.questions(docs_.column("shard")[0].as_py(), word_part(key), lambda a, b: differences(key[a:b]), lambda a, b: sh.pack(n[a:b]))

    def words_of_part(asked: pa.Table):
        keys = [from_differences(x.as_py()) for x in asked.column("keys")]
        return add_up_runs(keys, [sh.unpacked(x.as_py(), np.uint32) for x in asked.column("values")])

    def answer(asked: pa.Table) -> pa.Table:
        _, sums, places = words_of_part(asked)
        return sh.answers(asked, 0, [sh.pack(sums[x]) for x in places])

    def totals(asked: pa.Table) -> pa.Table:
        """N and V of one part."""
        _, sums, _ = words_of_part(asked)
        return pa.table({"n": [int(sums.sum())], "v": [int((sums > 0).sum())]})

    def shard_grams(docs_: pa.Table):
        """Symbol first and then the context from its end on: so grams of one state and symbol, which score alike, are neighbours."""
        codes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for lo, _, data, at in text_blocks(sh.one(docs_, "text"), BLOCK_BYTES):
            data = LOWER[data]
            code, row = grams(data, Words(data, at), LONG)
            codes.append(code.byteswap(inplace=True))
            rows.append((lo + row).astype(np.int32))
        return np.concatenate(codes), np.concatenate(rows)

    def tree_part(key: np.ndarray) -> np.ndarray:
        return (mix(key.byteswap() >> U64(8) & U64((1 << 8 * (SHORT + 1)) - 1)) % U64(parts)).astype(np.int32)

    def distinct(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code.sort()
        begin, length = runs(code)
        return code[begin], length

    def ask_tree(docs_: pa.Table) -> pa.Table:
        code, row = shard_grams(docs_)
        learned = learning(docs_)[row]
        seen, other = code[learned], code[~learned]
        del code, row, learned  # a shard's arrays are large
        (seen, many), (other, _) = distinct(seen), distinct(other)
        key, n, _ = add_up_runs([seen, other], [many, 0])
        part = tree_part(key)
        by_part = np.argsort(part, kind="stable")
        key, n = key[by_part], n[by_part].astype(np.uint32)
        return sh.questions(docs_.column("shard")[0].as_py(), part[by_part], lambda a, b: differences(key[a:b]), lambda a, b: sh.pack(n[a:b]))

    def answer_tree(asked: pa.Table) -> pa.Table:
        keys = [from_differences(x.as_py()) for x in asked.column("keys")]
        key, n, places = add_up_runs(keys, [sh.unpacked(x.as_py(), np.uint32) for x in asked.column("values")])
        code = key.byteswap()
        own = candidates(code[n > 0], n[n > 0], range(SHORT + 1, LONG + 1))
        score = log_probabilities(code, grow(*(np.concatenate(x) for x in zip(short.value, own)), ordered=True)).astype(np.float32)
        score = (score.view(np.uint32) + np.uint32(0x80) & np.uint32(0xFFFFFF00)).view(np.float32)  # to one part in 65,536, which packs better
        return sh.answers(asked, 1, [sh.pack(score[x]) for x in places])

    def finish(docs_: pa.Table, replies: pa.Table) -> pa.Table:
        ids = sh.one(docs_, "doc_id")
        n = len(ids)
        _, row, _, length = tokens(docs_)
        c = np.repeat(np.concatenate([sh.unpacked(x, np.int64) for x in sh.ordered(replies, 0)]), length)
        counts, known, n_tokens = by_row(row, n, np.log10(c + 0.1)), by_row(row, n, (c > 0).astype(float)).astype(np.int64), by_row(row, n)
        code, row = shard_grams(docs_)
        key, _ = distinct(code.copy())
        log_p = np.empty(len(key), np.float32)
        log_p[np.argsort(tree_part(key), kind="stable")] = np.concatenate([sh.unpacked(x, np.float32) for x in sh.ordered(replies, 1)])
        score = np.zeros(n)
        for a in range(0, len(code), SYMBOLS):
            some, its = code[a : a + SYMBOLS], row[a : a + SYMBOLS]
            order = order_of(mix(some.copy()))  # equal grams together
            some, its = some[order], its[order]
            begin, length = runs(some)
            one = some[begin]
            order = np.argsort(one)
            value = np.empty(len(one))
            value[order] = log_p[np.searchsorted(key, one[order])]
            score += by_row(its, n, np.repeat(value, length))
        fold_ = remainder(ids)
        return pa.table([ids, pa.array(fold_ == held_out), pa.array(n_tokens), pa.array(known), pa.array(counts), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "score"])

    asked = dealt.groupBy("shard").applyInArrow(lambda docs_: relax(ask(docs_)), sh.QUESTION)
    replies = sh.answer(asked, answer).unionByName(sh.ask(dealt, ask_tree, answer_tree))
    scored = sh.meet(dealt, replies, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double")
    corpus = asked.groupBy("part").applyInArrow(totals, "n long, v long").agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).alias("t"))
    scored = scored.withColumn("t", corpus.scalar())
    base = F.col("log_counts") - F.col("n_tokens") * F.log10(F.col("t.n") + 0.1 * (F.col("t.v") + 1))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.col("t.n").alias("train_tokens"), base.alias("base_score"), "score")


def base_in_memory(rows: list[tuple], modulus: int = 10, held_out: int = 0) -> list[tuple]:
    """Brute force over (doc_id, text): (doc_id, held_out, n_tokens, n_known, train_tokens, base_score).  For tests."""
    import re
    from collections import Counter

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + ["\n"] for _, t in rows]
    fold_ = [None if i is None else zlib.crc32(str(i).encode()) % modulus for i, _ in rows]
    counts = Counter(w for words, f in zip(split, fold_) if f is not None and f != held_out for w in words)
    total, size = sum(counts.values()), len(counts)
    return [(i, f == held_out, len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (size + 1))) for x in w)) for (i, _), w, f in zip(rows, split, fold_)]
