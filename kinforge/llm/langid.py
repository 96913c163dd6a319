"""Language identification: a linear-chain conditional random field over the words of a text.

Every whitespace-separated word has affix, byte n-gram and lexicon features (hashed), whose weights give a score per
language; learned transition weights join neighbouring words.  Forward-backward gives each word's posterior, so a text
that switches language gets different labels along the way; a text's language is the one of the largest mean posterior
over its words that hold a letter, and that mean is the score.

Training sequences are spliced from runs of words of different labelled texts, so that transitions between languages
are seen; of a long text the runs come from stretches at random places all over it.  A null text or one without any letter is ``und`` with score 0.  Ties go to the smaller language name.  Null
ids are labelled, never learned from.  Repeated rows get equal results.  Without any labelled text everything is
``und``.  Only ``doc_id``, ``text`` and (in training) ``lang`` are read; other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fold, map_batches, one_each, smallest_hashes
from .textkit import LETTER_ASCII, LOWER, NOT_SPACE, Rolling, Words, by_row, byte_class, mix, runs, spans, string_buffers, text_blocks

SAMPLE_ROWS, SAMPLE_WORDS, LONGEST = 3_000, 480, 256  # learned from: documents, words of each, bytes of a word
HASH_BITS = 16
SEQUENCES, SEQUENCE_WORDS, RUN_WORDS = 4_000, 48, 12
EPOCHS, BATCH, RATE, DECAY = 6, 200, 0.2, 1e-5
BLOCK_BYTES = 3 << 20
WORDS_AT_ONCE = 1 << 15  # whose features are held together
CHUNK_WORDS = 512  # of a long text, labelled in step with its other chunks
_WIDE = byte_class((0x80, 0xFF))
_LETTERLIKE = LETTER_ASCII | _WIDE


def word_features(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashing: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all features: prefixes of 1-3 and suffixes of 1-4 bytes, 2- and 3-grams, and the word itself."""
    n = np.arange(len(starts))
    word, bucket = [], []

    def add(kind: int, of: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        h = hashing.slices(sums, lo, hi) + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        word.append(of)
        bucket.append((mix(h) >> np.uint64(64 - HASH_BITS)).astype(np.int32))

    for k in (1, 2, 3):
        add(k, n, starts, np.minimum(starts + k, ends))
    for k in (1, 2, 3, 4):
        add(8 + k, n, np.maximum(ends - k, starts), ends)
    for k in (2, 3):
        many = np.maximum(ends - starts - k + 1, 0)
        lo = spans(starts, many)
        add(16 + k, np.repeat(n, many), lo, lo + k)
    add(24, n, starts, ends)
    return np.concatenate(word), np.concatenate(bucket)


@dataclass(frozen=True)
class WordCRF:
    languages: tuple  # sorted names
    weights: np.ndarray  # bucket x language
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashing: Rolling) -> np.ndarray:
        sums, out = hashing.sums(data, LOWER), np.empty((len(starts), len(self.languages)))
        for a in range(0, len(starts), WORDS_AT_ONCE):
            some = slice(a, a + WORDS_AT_ONCE)
            word, bucket = word_features(sums, starts[some], ends[some], hashing)
            for k in range(len(self.languages)):
                out[some, k] = by_row(word, len(out[some]), self.weights[bucket, k].astype(float))
        return out

    def posteriors(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Forward-backward over all sequences of a block in step: sequence i is scores[first[i]:first[i + 1]].

        Long sequences are cut into chunks that go in step too.  A chunk's product of transitions and emissions carries
        the forward message over it to the next one, and the backward message to the one before, so nothing is lost.
        """
        many = np.diff(first)
        if not len(many) or many.max() <= CHUNK_WORDS:
            return forward_backward(scores, first, self.transitions, self.start)[0]
        pieces = np.maximum(-(-many // CHUNK_WORDS), 1)
        owner = np.repeat(np.arange(len(many)), pieces)
        lead = np.cumsum(pieces) - pieces  # each sequence's first chunk
        cuts = np.append(first[owner] + (np.arange(len(owner)) - lead[owner]) * CHUNK_WORDS, first[-1])
        size = np.diff(cuts)
        step = np.exp(self.transitions - self.transitions.max())
        linked = np.flatnonzero(pieces[owner] > 1)
        order = linked[np.argsort(-size[linked], kind="stable")]
        over = np.empty((len(order), *step.shape))
        for t in range(int(size[order].max())):
            live = int(np.searchsorted(-size[order], -t, "left"))
            at = cuts[order[:live]] + t
            emit = np.exp(scores[at] - scores[at].max(1, keepdims=True))[:, None, :]
            over[:live] = np.eye(len(step)) * emit if t == 0 else (over[:live] @ step) * emit
            over[:live] /= over[:live].sum((1, 2), keepdims=True)
        of = dict(zip(order.tolist(), over))
        entry = np.tile(np.exp(self.start - self.start.max()), (len(owner), 1))
        leave = np.ones_like(entry)
        for i in np.flatnonzero(pieces > 1):
            a, b = int(lead[i]), int(lead[i] + pieces[i])
            for c in range(a + 1, b):
                v = entry[c - 1] @ of[c - 1] @ step
                entry[c] = v / v.sum()
            for c in range(b - 2, a - 1, -1):
                v = step @ (of[c + 1] @ leave[c + 1])
                leave[c] = v / v.sum()
        return forward_backward(scores, cuts, self.transitions, self.start, ends=(entry, leave))[0]


def forward_backward(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, start: np.ndarray, want_pairs: bool = False, ends: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of every position, and the expected transition counts if asked for.

    ``ends`` gives each sequence's own messages before its first and after its last position.
    """
    many = np.diff(first)
    order = np.argsort(-many, kind="stable")
    head, many = first[:-1][order], many[order]
    steps = int(many[0]) if len(many) else 0
    active = np.searchsorted(-many, -np.arange(steps), "left")  # sequences with more than t words
    emit = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    step = np.exp(transitions - transitions.max())
    forward, out = np.empty_like(emit), np.empty_like(emit)
    entry, leave = (x[order] for x in ends) if ends else (np.exp(start - start.max())[None], np.ones((1, emit.shape[1])))
    a = np.zeros((0, emit.shape[1]))
    for t in range(steps):
        at = head[: active[t]] + t
        a = (entry[: active[t]] if t == 0 else a[: active[t]] @ step) * emit[at]
        a = a / a.sum(1, keepdims=True)
        forward[at] = a
    pairs = np.zeros_like(step)
    b = np.zeros((0, emit.shape[1]))
    for t in range(steps - 1, -1, -1):
        grown = np.array(np.broadcast_to(leave[: active[t]], (active[t], emit.shape[1])))
        at = head[: active[t]] + t
        if len(b):
            ahead = b * emit[at[: len(b)] + 1]
            grown[: len(b)] = ahead @ step.T
            if want_pairs:
                joint = forward[at[: len(b)]][:, :, None] * step[None] * ahead[:, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        b = grown / grown.sum(1, keepdims=True)
        out[at] = forward[at] * b
        out[at] /= out[at].sum(1, keepdims=True)
    return out, pairs


def fit_crf(texts: list[str], langs: list[str], seed: int = 5) -> WordCRF:
    """Maximum likelihood by AdaGrad over spliced sequences of the labelled texts."""
    names = sorted(set(langs))
    if not names:
        return WordCRF((), np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0))
    hashing, rng = Rolling(1), np.random.default_rng(seed)
    data, at = string_buffers(pa.array(texts, pa.large_string()))
    words = Words(data, at)
    tag = np.array([names.index(x) for x in langs])
    usable = [np.flatnonzero((tag == k) & (words.counts > 0)) for k in range(len(names))]
    k_of = [k for k in range(len(names)) if len(usable[k])]
    index, label = [], []
    for _ in range(SEQUENCES if k_of else 0):
        left = SEQUENCE_WORDS
        while left > 0:  # runs of one language, of geometric length
            k = k_of[rng.integers(len(k_of))]
            doc = usable[k][rng.integers(len(usable[k]))]
            run = min(left, int(rng.geometric(1 / RUN_WORDS)), int(words.counts[doc]))
            begin = words.first[doc] + rng.integers(words.counts[doc] - run + 1)
            index.append(np.arange(begin, begin + run))
            label.append(np.full(run, k))
            left -= run
    if not index:
        return WordCRF(tuple(names), np.zeros((1 << HASH_BITS, len(names)), np.float32), np.zeros((len(names),) * 2), np.zeros(len(names)))
    index, label = np.concatenate(index).reshape(-1, SEQUENCE_WORDS), np.concatenate(label).reshape(-1, SEQUENCE_WORDS)
    size = len(names)
    w, t, s = np.zeros((1 << HASH_BITS, size)), np.zeros((size, size)), np.zeros(size)
    gw, gt, gs = np.full_like(w, 1e-6), np.full_like(t, 1e-6), np.full_like(s, 1e-6)
    word, bucket = word_features(hashing.sums(data, LOWER), words.starts[index.ravel()], words.ends[index.ravel()], hashing)
    order = np.argsort(word, kind="stable")
    word, bucket = word[order], bucket[order]
    begins = np.searchsorted(word, np.arange(index.size + 1))
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(index)), max(1, len(index) // BATCH)):
            flat = (rows[:, None] * SEQUENCE_WORDS + np.arange(SEQUENCE_WORDS)).ravel()
            many = begins[flat + 1] - begins[flat]
            b, of = bucket[spans(begins[flat], many)], np.repeat(np.arange(len(flat)), many)
            scores = np.column_stack([by_row(of, len(flat), w[b, k]) for k in range(size)])
            first = np.arange(len(rows) + 1) * SEQUENCE_WORDS
            got, pairs = forward_backward(scores, first, t, s, want_pairs=True)
            y = label[rows]
            off = got.copy()
            off[np.arange(len(flat)), y.ravel()] -= 1
            off /= len(rows)
            used, back = np.unique(b, return_inverse=True)
            g = np.column_stack([np.bincount(back, off[of, k], len(used)) for k in range(size)]) + DECAY * w[used]
            gw[used] += g**2
            w[used] -= RATE * g / np.sqrt(gw[used])
            seen = np.zeros_like(t)
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            g = (pairs - seen) / len(rows) + DECAY * t
            gt += g**2
            t -= RATE * g / np.sqrt(gt)
            g = (got[first[:-1]].sum(0) - np.bincount(y[:, 0], minlength=size)) / len(rows)
            gs += g**2
            s -= RATE * g / np.sqrt(gs)
    return WordCRF(tuple(names), w.astype(np.float32), t, s)


def fit_langid(docs: DataFrame, modulus: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS) -> WordCRF:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, chosen by a hash of the id; an id counts once.

    The driver gets at most SAMPLE_WORDS words of a document, in stretches as long as a training sequence, and no word
    longer than LONGEST bytes.
    """

    def stretches(batch: pa.RecordBatch):
        for lo, hi, data, at in text_blocks(batch.column(1), BLOCK_BYTES):
            words, out = Words(data, at), []
            for i, doc_id in enumerate(batch.column(0).slice(lo, hi - lo).to_pylist()):
                a, many = int(words.first[i]), int(words.counts[i])
                own = np.arange(a, a + many)
                if many > SAMPLE_WORDS:
                    at_random = np.random.default_rng(doc_id % 2**32).integers(0, many - SEQUENCE_WORDS, SAMPLE_WORDS // SEQUENCE_WORDS)
                    own = a + (at_random[:, None] + np.arange(SEQUENCE_WORDS)).ravel()
                out.append(b" ".join(data[s:e].tobytes() for s, e in zip(words.starts[own], words.ends[own]) if e - s <= LONGEST).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.string()), batch.column(2).slice(lo, hi - lo)], names=["doc_id", "text", "lang"])

    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", modulus) != held_out))
    usable = usable.select(F.col("doc_id").cast("long").alias("_id"), "text", "lang")
    few = usable.join(F.broadcast(smallest_hashes(usable, rows)), "_id", "left_semi")  # at most ``rows`` ids
    got = one_each(map_batches(few, stretches, "doc_id long, text string, lang string")).toPandas().sort_values("doc_id")
    return fit_crf(list(got["text"]), list(got["lang"]))


def has_letter(texts: list) -> list[bool]:
    return [x is not None and any(c.isalpha() for c in x) for x in texts]


def label_words(text: str, model: WordCRF) -> list[tuple[str, str]]:
    """(word, language) along one text, as forward-backward labels it."""
    data, at = string_buffers(pa.array([text or ""], pa.large_string()))
    words = Words(data, at)
    got = model.posteriors(model.emissions(data, words.starts, words.ends, Rolling(1)), words.first) if len(words) else np.zeros((0, 1))
    return [(bytes(data[a:b]).decode("utf-8", "replace"), model.languages[k]) for a, b, k in zip(words.starts, words.ends, got.argmax(1) if len(words) else [])]


def identify(docs: DataFrame, model: WordCRF) -> DataFrame:
    """doc_id, lang_pred, score, n_switches (changes of the likeliest language along the text's words) of every row."""

    def kernel(batch: pa.RecordBatch):
        hashing, size = Rolling(1), len(model.languages)
        for lo, hi, data, at in text_blocks(batch.column(1), BLOCK_BYTES):
            n = hi - lo
            pred, score, switches = ["und"] * n, np.zeros(n), np.zeros(n, np.int64)
            words = Words(data, at)
            if len(words) and size:
                keys = hashing.words(data, words, LOWER)
                order = np.argsort(keys)
                begin, length = runs(keys[order])
                which = np.empty(len(words), np.int32)  # each distinct word is scored once
                which[order] = np.repeat(np.arange(len(begin), dtype=np.int32), length)
                one = order[begin]
                got = model.posteriors(model.emissions(data, words.starts[one], words.ends[one], hashing)[which], words.first)
                best = got.argmax(1)
                change = (best[1:] != best[:-1]) & (words.row[1:] == words.row[:-1])
                switches = by_row(words.row[1:][change], n)
                letters = np.concatenate(([0], np.cumsum(_LETTERLIKE[data])))
                lettered = letters[words.ends] > letters[words.starts]
                row, got = words.row[lettered], got[lettered]
                many = by_row(row, n)
                mean = np.column_stack([by_row(row, n, got[:, k]) for k in range(size)]) / np.maximum(many, 1)[:, None]
                top = mean.argmax(1)
                ascii_letter = np.diff(np.concatenate(([0], np.cumsum(LETTER_ASCII[data])))[at]) > 0
                unsure = np.flatnonzero(~ascii_letter & (many > 0))  # only other characters: ask Unicode
                real = ascii_letter.copy()
                real[unsure] = has_letter([bytes(data[at[i] : at[i + 1]]).decode("utf-8", "replace") for i in unsure])
                score = np.where(real, np.clip(mean.max(1), 0, 1), 0)
                pred = [model.languages[k] if ok else "und" for k, ok in zip(top, real)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(pred, pa.string()), pa.array(score), pa.array(switches.astype(np.int64))], names=["doc_id", "lang_pred", "score", "n_switches"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), kernel, "doc_id long, lang_pred string, score double, n_switches long")


def language_id(docs: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """Fit, then label every document: doc_id, held_out, lang_pred, score, n_switches."""
    got = identify(docs, fit_langid(docs, modulus, held_out))
    return got.select("doc_id", F.coalesce(fold("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_switches")
