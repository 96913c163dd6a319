"""The trained models against plain restatements, and what they learn from."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinforge.llm import frames, langid, pieces, quality, suffixtree
from kinforge.llm.textkit import Rolling, string_buffers


def test_discriminant_by_definition():
    """Densities with an explicit inverse and determinant, by Bayes' rule."""
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(0, 1, (60, 4)) @ rng.normal(size=(4, 4)), rng.normal(1, 2, (40, 4)) @ rng.normal(size=(4, 4))))
    y = np.repeat([0, 1], (60, 40))
    model = quality.fit_discriminant(x, y, shrink=0.2, ridge=0.05)
    z = (x - x.mean(0)) / x.std(0)
    density = []
    for c in (0, 1):
        own = z[y == c]
        centred = own - own.mean(0)
        cov = centred.T @ centred / (len(own) - 1)
        cov = np.where(np.eye(4) > 0, cov + 0.05, 0.8 * cov)
        apart = z - own.mean(0)
        form = np.array([d @ np.linalg.inv(cov) @ d for d in apart])
        density.append(len(own) / 100 * np.exp(-form / 2) / math.sqrt(np.linalg.det(2 * math.pi * cov)))
    assert model.score(x) == pytest.approx(density[1] / (density[0] + density[1]))


def test_document_statistics_by_definition():
    texts = ["A plain text, with words.", "", "BUY now!!! $$$ buy now!!! <a> ok! # 100%", "word " * 50, "ééé ß ÀB c", "x"]
    data, at = string_buffers(pa.array(texts, pa.large_string()))
    got = quality.statistics(data, at, Rolling(2))
    symbols = set("#$%&*+<=>[\\]^_`{|}~")
    for text, row in zip(texts, got):
        raw = text.encode()
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
        lower = [w.lower() for w in words]
        w, letters, solid = max(len(words), 1), sum(b > 127 or chr(b).isalpha() for b in raw), sum(len(x) for x in words)
        bare = [len(x) <= 3 and chr(x[0]) in symbols and chr(x[-1]) in symbols for x in words]
        want = [
            math.log1p(len(words)),
            math.log(0.03 + sum(65 <= b <= 90 for b in raw) / (letters + 30)),
            math.log(0.005 + sum(chr(b) in symbols for b in raw) / (solid + 20)),
            math.log(0.02 + sum(bare) / w),
            math.log(0.02 + sum(chr(x[-1]) in symbols and not b for x, b in zip(words, bare)) / w),
            math.log(0.02 + sum(a == b for a, b in zip(lower, lower[1:])) / w),
            math.log(max(len(set(lower)), 1)) - 0.9 * math.log(w),
            math.log(0.05 + max(Counter(lower).values(), default=0) / (w + 10)),
            math.log1p((solid + 60) / (w + 10)),
            math.log(0.02 + sum(x[-1:] == b"!" for x in words) / w),
        ]
        assert row == pytest.approx(want), text


def walk(text: str, counts: list[dict], kept: set) -> float:
    """log10 probability by recursion over strings: the longest kept suffix, Witten-Bell down to a uniform root."""

    def probability(context: bytes, symbol: int) -> float:
        below = probability(context[1:], symbol) if context else 1 / 256
        seen = counts[len(context)].get(context, {})
        total, kinds = sum(seen.values()), len(seen)
        return below if not total else seen.get(symbol, 0) / (total + kinds) + kinds / (total + kinds) * below

    stream = b"\n" * suffixtree.LONG + " ".join(text.split()).lower().encode() + b"\n"
    out = 0.0
    for i in range(suffixtree.LONG, len(stream)):
        context = next(stream[i - k : i] for k in range(suffixtree.LONG, -1, -1) if stream[i - k : i] in kept)
        out += math.log10(probability(context, stream[i]))
    return out


def test_suffix_tree_by_definition(spark):
    """Counts, the divergence test, the smoothing and the choice of states, restated over dictionaries of strings."""
    rng = random.Random(3)
    words = ["abcab", "bcabc", "cab", "ab", "bbbb", "acacac", "zz"]
    rows = [(i, " ".join(rng.choice(words[: 3 + i % 5]) for _ in range(60))) for i in range(30)] + [(100, ""), (101, None), (102, "new Words zzab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learned = {r["doc_id"] for r in docs.where(frames.fold("doc_id", 10) != 0).collect()}
    counts: list[dict] = [{} for _ in range(suffixtree.LONG + 1)]
    for i, text in rows:
        stream = b"\n" * suffixtree.LONG + " ".join((text or "").split()).lower().encode() + b"\n"
        for at in range(suffixtree.LONG, len(stream) if i in learned else 0):
            for k in range(suffixtree.LONG + 1):
                seen = counts[k].setdefault(stream[at - k : at], {})
                seen[stream[at]] = seen.get(stream[at], 0) + 1
    counts = [{c: s for c, s in level.items() if sum(s.values()) >= suffixtree.LEAST} for level in counts]
    kept = {b""}
    for k, level in enumerate(counts):
        for context, seen in level.items():
            total = sum(seen.values())
            above = counts[k - 1][context[1:]] if k else seen
            gain = sum(n * math.log(n / total / (above[s] / sum(above.values()))) for s, n in seen.items())
            if k <= suffixtree.SHORT or gain >= suffixtree.DIVERGENCE:
                kept |= {context[j:] for j in range(k + 1)}
    assert any(len(c) > suffixtree.SHORT for c in kept) and len(kept) < sum(map(len, counts))
    got = {r["doc_id"]: r["score"] for r in suffixtree.score_lm(docs, shards=2).collect()}
    assert [got[i] for i, _ in rows] == pytest.approx([walk(t or "", counts, kept) for _, t in rows], rel=2e-5)


def test_samples_are_bounded(spark):
    """The rows with the smallest hashes, each id once, long texts as stretches of whole words."""
    ids = spark.range(20_000).select((F.col("id") % 9_000).alias("_id"))
    want = [r[0] for r in ids.distinct().orderBy(F.xxhash64("_id"), "_id").limit(50).collect()]
    assert [r[0] for r in frames.smallest_hashes(ids, 50).collect()] == want
    assert frames.smallest_hashes(ids.limit(0), 50).count() == 0
    long = " ".join(f"word{i}" for i in range(5_000))
    rows = [(k, f"{side} " * 30, lang) for k, (side, lang) in enumerate([("thing other with", "en"), ("llave más señal", "es")] * 10)] + [(50, long, "en"), (50, long, "en"), (51, "x" * 5_000 + " más", "es")]
    taken = {}
    real, langid.fit_crf = langid.fit_crf, lambda texts, langs: taken.update(texts=texts, langs=langs) or real(texts, langs)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = langid.fit_langid(docs, held_out=9)
    finally:
        langid.fit_crf = real
    assert len(taken["texts"]) == 22 and taken["texts"][-1] == "más" and taken["texts"][0] == rows[0][1].strip()
    some = taken["texts"][-2].split()
    assert len(some) == langid.SAMPLE_WORDS and set(some) <= set(long.split()) and len(set(some)) > 300
    assert langid.label_words("thing más", model) == [("thing", "en"), ("más", "es")]


def test_long_texts_go_in_chunks():
    rng = np.random.default_rng(0)
    model = langid.WordCRF(tuple("abcd"), np.zeros((1, 4)), rng.normal(size=(4, 4)), rng.normal(size=4))
    first = np.concatenate(([0], np.cumsum([0, 3, 1500, langid.CHUNK_WORDS, langid.CHUNK_WORDS + 1, 0, 2 * langid.CHUNK_WORDS, 1])))
    scores = 3 * rng.normal(size=(first[-1], 4))
    want = langid.forward_backward(scores, first, model.transitions, model.start)[0]
    assert np.abs(model.posteriors(scores, first) - want).max() < 1e-9


def test_long_runs_without_blanks_are_split_exactly():
    model = pieces.load_model()
    automaton, draw = pieces.Automaton(model), random.Random(1)
    texts = ["".join(chr(draw.randrange(0x4E00, 0x5E00)) for _ in range(600)), "的一是不了人我在有他这中大来上国个到说们" * 30, "naïve的is" * 90, "a" * 300 + "é" * 200 + "日本語" * 40 + "👍🏽" * 30, "word " * 50 + "x" * 200]
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        got, want = automaton.encode(data, np.array([0, len(data)]), Rolling(7))[0].tolist(), pieces.encode_in_memory(text, model)
        total = lambda ids: sum(model.scores[i] for i in ids)
        assert got == want or "x" * 200 in text and np.isclose(total(got), total(want))  # runs of x have several optima
    long = np.frombuffer("".join(chr(draw.randrange(0x4E00, 0x5E00)) for _ in range(700_000)).encode(), np.uint8)
    began = time.perf_counter()
    ids, _ = automaton.encode(long, np.array([0, len(long)]), Rolling(7))
    assert time.perf_counter() - began < 20
    spelling = pieces.Spelling(model)
    assert next(spelling.texts(ids.astype(np.int64), np.array([0, len(ids)]))) == long.tobytes()
