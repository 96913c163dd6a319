"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Per class a mean and a covariance shrunk towards the pooled diagonal are fitted; the inverse Cholesky factors are kept
in the model, and a score is the logistic of the difference of the two Gaussian log densities (Mahalanobis forms) plus
the log ratio of the class sizes.

Null and empty texts have the statistics of an empty text and are scored like any other.  A row with a null id is
scored and is never learned from.  Repeated rows are scored alike.  With no labelled rows of both classes the model
gives every text the share of label 1 (0.5 without any label).  Only ``doc_id`` and ``text`` are read; other columns
may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import fold, labelled_sample, map_batches, one_each
from .textkit import LETTER_ASCII, LOWER, NOT_SPACE, Rolling, Words, by_row, byte_class, mix, runs, text_blocks

SAMPLE_ROWS = 20_000
SHRINK, RIDGE = 0.1, 0.02
THRESHOLD = 0.7
FEATURES = ("log_words", "upper_share", "symbol_share", "bare_symbol_words", "symbol_ended_words", "same_as_previous", "type_token", "top_word_share", "word_length", "exclaimed")

_UPPER = byte_class((0x41, 0x5A))
_SYMBOL = byte_class((0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x5B, 0x60), (0x7B, 0x7E))  # # $ % & * + < = > [ \ ] ^ _ ` { | } ~
_LETTERLIKE = LETTER_ASCII | byte_class((0x80, 0xFF))


def statistics(data: np.ndarray, at: np.ndarray, hashing: Rolling) -> np.ndarray:
    """One row of FEATURES per text; shares carry pseudo-counts, so that a few words alone are no evidence."""
    n = len(at) - 1
    words = Words(data, at, NOT_SPACE)
    w = np.maximum(words.counts, 1).astype(float)
    row = words.row
    count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[at]).astype(float)
    letters = count(_LETTERLIKE[data])
    solid = count(NOT_SPACE[data])
    hashes = hashing.words(data, words, LOWER)
    last, head = data[words.ends - 1], data[words.starts]
    bare = (words.ends - words.starts <= 3) & _SYMBOL[head] & _SYMBOL[last]
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    keyed = np.sort(mix(hashes.copy()) >> np.uint64(24) | row.astype(np.uint64) << np.uint64(40)) if n < 1 << 24 else np.zeros(0, np.uint64)
    first, length = runs(keyed)
    of = (keyed[first] >> np.uint64(40)).astype(np.int64)
    distinct = np.maximum(by_row(of, n), 1)
    top = np.zeros(n)
    np.maximum.at(top, of, length)
    mean_length = by_row(row, n, (words.ends - words.starts).astype(float)) / w
    return np.column_stack(
        [
            np.log1p(words.counts),
            np.log(0.03 + count(_UPPER[data]) / (letters + 30)),
            np.log(0.005 + count(_SYMBOL[data]) / (solid + 20)),
            np.log(0.02 + by_row(row, n, bare.astype(float)) / w),
            np.log(0.02 + by_row(row, n, (_SYMBOL[last] & ~bare).astype(float)) / w),
            np.log(0.02 + by_row(row, n, same.astype(float)) / w),
            np.log(distinct) - 0.9 * np.log(w),
            np.log(0.05 + top / (w + 10)),
            np.log1p((mean_length * w + 60) / (w + 10)),
            np.log(0.02 + by_row(row, n, (last == 0x21).astype(float)) / w),
        ]
    )


@dataclass(frozen=True)
class Discriminant:
    """centre and scale standardise; per class: mean, inverse Cholesky factor of the covariance, log determinant, prior."""

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        density = [np.log(prior) - half_log_det - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, half_log_det, prior in self.classes]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit_discriminant(x: np.ndarray, y: np.ndarray, shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
    share = float(np.mean(y)) if len(y) else 0.5
    if len(x) == 0 or min((y == 0).sum(), (y == 1).sum()) < 2:
        return Discriminant(np.zeros(x.shape[1]), np.ones(x.shape[1]), (), share)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - centre) / scale
    classes = []
    for c in (0, 1):
        own = z[y == c]
        cov = np.cov(own.T)
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + ridge * np.eye(len(centre))
        lower = np.linalg.cholesky(cov)
        classes.append((own.mean(0), np.linalg.inv(lower), float(np.log(np.diag(lower)).sum()), len(own) / len(z)))
    return Discriminant(centre, scale, tuple(classes), share)


def document_statistics(docs: DataFrame, keep: str, kinds: str) -> DataFrame:
    """``keep`` columns (comma list, typed by ``kinds``) and the statistics of ``text``."""
    names = keep.split(",")

    def kernel(batch: pa.RecordBatch):
        hashing = Rolling(2)
        for lo, hi, data, at in text_blocks(batch.column(len(names))):
            x = statistics(data, at, hashing)
            yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(len(names))] + [pa.array(x[:, j]) for j in range(x.shape[1])], names=names + list(FEATURES))

    return map_batches(docs.select(*names, "text"), kernel, kinds + ", " + ", ".join(f"{f} double" for f in FEATURES))


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS) -> Discriminant:
    """Fit on at most ``rows`` labelled documents outside the held-out fold; an id is learned from once."""
    got = one_each(document_statistics(labelled_sample(docs, labels, "quality", modulus, held_out, rows), "doc_id,y", "doc_id long, y int")).toPandas()
    got = got.sort_values(["y", *FEATURES])  # the same sums whatever the order of the partitions
    return fit_discriminant(got[list(FEATURES)].to_numpy(float), got["y"].to_numpy())


def score_quality(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``; with ``keep`` also text and, of further columns, ``row``."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if keep else []
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")] if others else []))
    carried = [c for c in frame.columns if keep or c == "doc_id"]

    def kernel(batch: pa.RecordBatch):
        hashing = Rolling(2)
        for lo, hi, data, at in text_blocks(batch.column(1)):
            score = model.score(statistics(data, at, hashing))
            own = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in carried), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*carried, "score", "predicted"])

    schema = T.StructType([*(frame.schema[c] for c in carried), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return map_batches(frame, kernel, schema)


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """Fit, then score every document: doc_id, held_out, score, predicted."""
    scored = score_quality(docs, fit_quality(docs, labels, modulus, held_out))
    return scored.select("doc_id", F.coalesce(fold("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
