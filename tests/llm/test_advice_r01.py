"""What the first round of advice found to be less than the whole job."""

import random

import numpy as np
import pyarrow as pa
import pytest

from kinforge.llm import suffixtree, toxicity
from kinforge.llm.textkit import LOWER, Words, string_buffers


def test_rare_contexts_outlive_a_large_common_part(spark):
    """A context seen some twenty times stays a state however long the rest is, and states of the shards are those of one tree."""
    rng = random.Random(4)
    rare = [(i, "3ab z 4ab w 1abcde x 2abcde y " * 3) for i in range(8)]
    common = [(100 + i, " ".join(rng.choice("abcdef") + rng.choice("ghijkl") for _ in range(150_000))) for i in range(16)]
    docs = spark.createDataFrame(rare + common, "doc_id long, text string").repartition(4)
    model = suffixtree.fit_tree(docs)
    for context in (b"3ab ", b"1abcde "):
        assert int.from_bytes(context, "big") | len(context) << 56 in model["key"].tolist()
    got = {r["doc_id"]: r["score"] for r in suffixtree.score_lm(docs, shards=3).collect()}
    rows = rare + common[:2]
    data, at = string_buffers(pa.array([t for _, t in rows]))
    data = LOWER[data]
    want = suffixtree.tree_scores(data, Words(data, at), model, suffixtree.LONG)
    assert np.array([got[i] for i, _ in rows]) == pytest.approx(want, rel=1e-5)


def test_pairs_without_marginal_gain_are_learned():
    """With the production settings: terms that tell nothing alone decide together."""
    rng = np.random.default_rng(2)
    n = 3000
    has = rng.random((n, 2)) < 0.5
    y = (has[:, 0] ^ has[:, 1]).astype(int)
    terms = [sorted({*rng.integers(10, 40, 3).tolist(), *(k + 1 for k in (0, 1) if has[i, k])}) for i in range(n)]
    row, bucket = np.repeat(np.arange(n), [len(t) for t in terms]), np.concatenate(terms)
    assert not toxicity.strong_terms(row, bucket, y)[[1, 2]].any()
    model = toxicity.fit_machine(row, bucket, y)
    score = model.score(row, model.slots[bucket].astype(np.int64), n)
    assert ((score > 0.5) == y).mean() > 0.95
