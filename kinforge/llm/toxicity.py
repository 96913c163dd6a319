"""Toxicity: a factorization machine over hashed terms.

score = logistic(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 where the text holds a term of bucket i.
The pairwise part is computed as (|sum v_i|^2 - sum |v_i|^2) / 2, so an insult next to a group mention can weigh more
than the two apart.  Terms are lower-cased runs of letters and digits hashed to 2**HASH_BITS buckets; training
fits every bucket of its texts by AdaGrad, also those that tell nothing about the label alone, as they may in a pair.
Only the penalty differs: DECAY on terms of a large likelihood ratio; on others WEAK_DECAY over the texts they are in.

Null and empty texts hold no term and get the logistic of the bias.  A null id is scored, never learned from.  Repeated
rows are scored alike.  Without labelled rows of both classes every score is the share of label 1 (0.5 without any
label).  Only ``doc_id`` and ``text`` are read; other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fold, labelled_sample, map_batches, one_each
from .textkit import ALNUM, LOWER, Rolling, Words, by_row, runs, spans, text_blocks

SAMPLE_ROWS = 8_000
HASH_BITS = 20
LEAST_DOCS, LEAST_GAIN, FACTORS = 5, 7.5, 8  # a gain of 7.5 nats comes by chance for one term in 10,000
UPDATES, BATCH, RATE, DECAY, WEAK_DECAY, INIT = 1250, 64, 0.2, 2e-5, 20.0, 0.01
THRESHOLD = 0.7


def document_terms(data: np.ndarray, at: np.ndarray, hashing: Rolling, slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct term of each text; with ``slots``, only buckets that have a slot, as slots."""
    data = LOWER[data]
    words = Words(data, at, ALNUM)
    bucket = (hashing.words(data, words) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    row = words.row
    if slots is not None:
        bucket = slots[bucket].astype(np.int64)
        row, bucket = row[bucket >= 0], bucket[bucket >= 0]
    keyed = np.sort(row << HASH_BITS | bucket)
    keyed = keyed[runs(keyed)[0]]
    return keyed >> HASH_BITS, keyed & ((1 << HASH_BITS) - 1)


@dataclass(frozen=True)
class FactorizationMachine:
    slots: np.ndarray  # bucket -> slot or -1
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, row: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        total = self.bias + by_row(row, n, self.weights[slot])
        for k in range(self.factors.shape[1]):
            v = self.factors[slot, k]
            total += 0.5 * (by_row(row, n, v) ** 2 - by_row(row, n, v * v))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def strong_terms(row: np.ndarray, bucket: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per bucket, whether it is in LEAST_DOCS texts or more and its likelihood ratio is LEAST_GAIN or more."""
    size = 1 << HASH_BITS
    n, n1 = len(y), y.sum()
    both = np.bincount(bucket, minlength=size).astype(float)
    one = np.bincount(bucket, y[row].astype(float), size)
    table = np.array([one, both - one, n1 - one, n - n1 - (both - one)])
    expected = np.array([both * n1, both * (n - n1), (n - both) * n1, (n - both) * (n - n1)]) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(table > 0, table * np.log(table / expected), 0).sum(0)
    return (both >= LEAST_DOCS) & (gain >= LEAST_GAIN)


class _Batch:
    """A fixed batch of texts: its terms by text and, through ``by_term``, by term, so that every epoch only adds up runs."""

    def __init__(self, docs: np.ndarray, first: np.ndarray, slot: np.ndarray):
        many = np.diff(first)[docs]
        self.docs, self.n, self.full = docs, len(docs), np.flatnonzero(many)
        many = many[self.full]
        self.slot = slot[spans(first[docs[self.full]], many)]
        self.text = np.repeat(np.arange(len(many)), many)
        self.begins = np.cumsum(many) - many
        self.by_term = np.argsort(self.slot, kind="stable")
        ordered = self.slot[self.by_term]
        self.term_begins, _ = runs(ordered)
        self.used = ordered[self.term_begins]

    def per_text(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.begins, axis=-1) if len(self.begins) else np.zeros((*x.shape[:-1], 0), x.dtype)

    def per_term(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[..., self.by_term], self.term_begins, axis=-1)


def fit_machine(row: np.ndarray, bucket: np.ndarray, y: np.ndarray, seed: int = 7) -> FactorizationMachine:
    """``row``, ``bucket``: distinct terms of the texts whose labels are ``y``."""
    share = float(y.mean()) if len(y) else 0.5
    slots = np.full(1 << HASH_BITS, -1, np.int32)
    if not len(y) or not 0 < share < 1:
        b = np.clip(share, 1e-3, 1 - 1e-3)
        return FactorizationMachine(slots, float(np.log(b / (1 - b))), np.zeros(1), np.zeros((1, 1)))
    chosen = np.unique(bucket)
    slots[chosen] = np.arange(len(chosen))
    decay = np.where(strong_terms(row, bucket, y)[chosen], DECAY, np.minimum(WEAK_DECAY / np.bincount(bucket)[chosen], 1.0))
    slot = slots[bucket].astype(np.int64)
    order = np.argsort(row, kind="stable")
    row, slot = row[order], slot[order]
    first = np.searchsorted(row, np.arange(len(y) + 1))
    rng = np.random.default_rng(seed)
    size = max(len(chosen), 1)
    batches = [_Batch(docs, first, slot) for docs in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH))]
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, INIT, (FACTORS, size)).astype(np.float32)
    gb, gw, gv = 1e-8, np.full(size, 1e-8, np.float32), np.full((FACTORS, size), 1e-8, np.float32)
    decay = decay.astype(np.float32)
    for _ in range(-(-UPDATES // len(batches))):
        for at in rng.permutation(len(batches)):
            b = batches[at]
            vs = v[:, b.slot]
            sums = b.per_text(vs)
            raw = np.full(b.n, bias, np.float32)
            raw[b.full] += b.per_text(w[b.slot]) + 0.5 * ((sums**2).sum(0) - b.per_text((vs**2).sum(0)))
            off = (1 / (1 + np.exp(-np.clip(raw, -80, 80))) - y[b.docs]).astype(np.float32)
            gb += (g := float(off.mean())) ** 2
            bias -= RATE * g / np.sqrt(gb)
            if not len(b.used):
                continue
            pull, penalty = off[b.full][b.text], decay[b.used]
            g = b.per_term(pull) / b.n + penalty * w[b.used]
            gw[b.used] += g**2
            w[b.used] -= RATE * g / np.sqrt(gw[b.used])
            g = b.per_term(pull * (sums[:, b.text] - vs)) / b.n + penalty * v[:, b.used]
            gv[:, b.used] += g**2
            v[:, b.used] -= 0.3 * RATE * g / np.sqrt(gv[:, b.used])
    return FactorizationMachine(slots, float(bias), w, v.T.copy())


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Fit on at most ``rows`` labelled documents outside the held-out fold; an id is learned from once."""

    def kernel(batch: pa.RecordBatch):
        hashing = Rolling(9)
        for lo, hi, data, at in text_blocks(batch.column(1)):
            row, bucket = document_terms(data, at, hashing)
            ends = np.searchsorted(row, np.arange(hi - lo + 1)) * 4
            blob = bucket.astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([blob[a:b] for a, b in zip(ends, ends[1:])], pa.binary())], names=["doc_id", "y", "terms"])

    got = one_each(map_batches(labelled_sample(docs, labels, "toxic", modulus, held_out, rows), kernel, "doc_id long, y int, terms binary")).toPandas().sort_values(["doc_id", "y", "terms"])
    terms = [np.frombuffer(x, np.uint32) for x in got["terms"]]
    row = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
    return fit_machine(row, np.concatenate(terms).astype(np.int64) if terms else np.zeros(0, np.int64), got["y"].to_numpy())


def score_toxicity(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``."""

    def kernel(batch: pa.RecordBatch):
        hashing = Rolling(9)
        for lo, hi, data, at in text_blocks(batch.column(1)):
            score = model.score(*document_terms(data, at, hashing, model.slots), hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), kernel, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """Fit, then score every document: doc_id, held_out, score, predicted."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels, modulus, held_out))
    return scored.select("doc_id", F.coalesce(fold("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
