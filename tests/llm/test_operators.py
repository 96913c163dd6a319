"""Training-data operators against brute force, round trips and held-out accuracy; and nulls, empties, ties, extras."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinforge.llm import covertree, decontaminate, langid, licences, neardup, pieces, quality, substrings, suffixtree, toxicity
from kinforge.llm.components import components
from kinforge.llm.queries import QUERIES
from kinforge.llm.textkit import Rolling, Words, string_buffers, text_blocks

WORDS = "the of and alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empties, blanks, repeats, copies, near copies, a very long text, a shared passage, other scripts."""
    rng = random.Random(3)
    base, passage = prose(rng, 120), prose(rng, 40)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "One two THREE four"), (9, "one TWO three four"),
        (10, prose(rng, 30) + " " + passage + " " + prose(rng, 30)), (11, passage), (12, prose(rng, 50) + "\n" + passage), (None, base), (None, passage),
        (13, prose(rng, 20000)), (14, "नि मैं ü é 😀 " + prose(rng, 20)), (15, "x" * 5000), (16, "ha " * 300), (7, "one"), (12, "another text of the same id " + base),
        (17, "A|B|C"), (18, prose(rng, 13)), (19, prose(rng, 12)),
    ]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    """With extra columns whose names clash with those the operators use."""
    clash = ["row", "shard", "class", "score", "ids", "n", "part", "_id"]
    frame = spark.createDataFrame([(*r, *("z" for _ in clash)) for r in odd_rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash))
    return frame.repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def in_order(rows):
    return sorted([tuple(r) for r in rows], key=str)


def test_words_and_blocks():
    texts = ["a  b", None, "", " c", "dd\te", "f"]
    column = pa.array(texts)
    for limit in (1, 5, 1000):
        got = []
        for lo, hi, data, at in text_blocks(column, limit):
            w = Words(data, at)
            for r in range(hi - lo):
                got.append([bytes(data[a:b]).decode() for a, b in zip(w.starts[w.first[r] : w.first[r + 1]], w.ends[w.first[r] : w.first[r + 1]])])
        assert got == [(t or "").split() for t in texts]
    data, at = string_buffers(pa.array(["ab cd", "ab cd"]).slice(1))
    h = Rolling(1).words(data, Words(data[at[0] :], at - at[0]))
    assert len(h) == 2 and h[0] != h[1]


def test_substring_dedup(spark, odd, odd_rows, none):
    got = substrings.remove_repeats(odd, shards=5)
    assert set(got.columns) == {"doc_id", "text", "row", "n_words", "n_removed", "kept_text"}
    rows = got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert in_order(rows) == in_order(substrings.remove_repeats_in_memory(odd_rows))
    assert substrings.remove_repeats(none).count() == 0
    copies = spark.createDataFrame([(i, " ".join(WORDS)) for i in range(300)], "doc_id long, text string").repartition(4)
    assert substrings.remove_repeats(copies, shards=3).where("n_removed = 0").select("doc_id").collect() == [(0,)]


def test_difference_cover():
    for difference in range(substrings.PERIOD):
        assert any((a - b) % substrings.PERIOD == difference for a in substrings.COVER for b in substrings.COVER)


def test_near_duplicates(spark, odd, odd_rows, none):
    assert in_order(neardup.near_duplicates(odd).collect()) != []
    known = [r for r in odd_rows]
    got, want = in_order(neardup.near_duplicates(odd).collect()), in_order(neardup.near_duplicates_in_memory(known))
    assert got == [tuple(None if i == 2 and r[0] is None else x for i, x in enumerate(r)) for r in want]
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_of_drifting_copies(spark):
    """Copies with edits in many places: a hub links only some, so later rounds and the prefix join must find the rest."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(100)]
    rows = [(1000, " ".join(base))]
    for i in range(120):
        text = list(base)
        for k in rng.sample(range(100), 1 + i % 5):
            text[k] = rng.choice(vocabulary)
        rows.append((i, " ".join(text)))
    for i in range(200, 260):  # the same passage, but not similar enough
        rows.append((i, " ".join(base[:55] + [rng.choice(vocabulary) for _ in range(25)])))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert in_order(got.collect()) == in_order(neardup.near_duplicates_in_memory(rows))


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    errors = []
    for overlap in (0.75, 0.85, 0.95):
        for _ in range(20):
            n = 2000
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = a.copy()
            fresh = int(n * (1 - overlap) / (1 + overlap))
            b[:fresh] = rng.integers(0, 1 << 63, fresh, dtype=np.uint64)
            sets, at = np.concatenate((np.sort(a), np.sort(b))), np.array([0, n, 2 * n])
            x, y = neardup.odd_sketches(neardup.minhashes(sets, at))
            differ = int(np.unpackbits(x ^ y).sum())
            m, k = neardup.SKETCH_BITS, neardup.BANDS * neardup.ROWS
            errors.append(1 + m / (4 * k) * np.log(1 - 2 * differ / m) - overlap)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(200)]
    loose = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    edges = chain + star + loose + [(5, 5), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"))[0].collect())
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    assert got == {x: find(x) for x in root}


def test_decontamination(spark, odd, odd_rows, none):
    passage = [t for i, t in odd_rows if i == 11][0]
    items = [(1, passage), (2, passage.upper() + " more words"), (3, "one"), (4, ""), (5, None), (None, "two"), (10, "THREE four"), (10, "ha ha ha"), (6, "never seen here at all")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit("clash"))
    want = in_order(decontaminate.contamination_in_memory(odd_rows, items))
    for options in ({}, {"item_bytes": 60}, {"block_bytes": 50}):
        got = decontaminate.decontaminate(odd, bench, **options).select("doc_id", "n_words", "n_hit", "n_items", F.array_join("items", ","), "contaminated")
        assert in_order(got.collect()) == want
    assert decontaminate.decontaminate(none, bench).count() == 0
    empty = decontaminate.decontaminate(odd, bench.limit(0))
    assert empty.where("n_hit > 0 or contaminated").count() == 0 and empty.count() == len(odd_rows)


def test_fm_index():
    rng = np.random.default_rng(4)
    for _ in range(20):
        text = rng.integers(0, 5, rng.integers(2, 400))
        text[-1] = 0
        index = decontaminate.FMIndex(text, 4)
        for length in (1, 2, 3, 5):
            patterns = rng.integers(1, 5, (20, length))
            lo, hi = index.search(patterns)
            for p, a, b in zip(patterns, lo, hi):
                want = [i for i in range(len(text) - length + 1) if (text[i : i + length] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffix_tree(spark, odd, odd_rows, none):
    model = suffixtree.fit_tree(odd.select("doc_id", "text"))
    for context in (*model["key"][-5:] & ((1 << 40) - 1), 12345):
        total = (10 ** suffixtree.log_probabilities((np.int64(context) << 8) | np.arange(256), model)).sum()
        assert total == pytest.approx(1)
    got = suffixtree.score_lm(odd, shards=3)
    want = in_order(suffixtree.base_in_memory(odd_rows))
    rows = in_order(got.drop("score").collect())
    assert [r[:5] for r in rows] == [r[:5] for r in want]
    assert all(a[5] == pytest.approx(b[5]) for a, b in zip(rows, want))
    assert all(r["score"] < 0 for r in got.collect())
    assert suffixtree.score_lm(none).count() == 0
    alone = suffixtree.score_lm(spark.createDataFrame([(0, "x")], "doc_id long, text string").where(F.crc32(F.lit("0")) >= 0)).collect()
    assert len(alone) == 1


def test_suffix_tree_scores_by_hand():
    """The vectorised score equals a walk along each text."""
    texts = ["ab ab ab", "", "abab b", "ab"]
    data, at = string_buffers(pa.array(texts))
    words = Words(data, at)
    codes, rows = suffixtree.grams(data, words)
    streams = [" ".join(t.split()).encode() + b"\n" for t in texts]
    want = [int.from_bytes((b"\n" * 5 + s)[i : i + 6], "big") for s in streams for i in range(len(s))]
    assert codes.tolist() == want and np.bincount(rows).tolist() == [len(s) for s in streams]
    full, counts = np.unique(codes, return_counts=True)
    d, c, s, n = [], [], [], []
    for depth in range(suffixtree.DEPTH + 1):
        part, inverse = np.unique(full & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        d += [depth] * len(part)
        c += (part >> np.uint64(8)).tolist()
        s += (part & np.uint64(255)).tolist()
        n += np.bincount(inverse, counts).astype(int).tolist()
    model = suffixtree.grow(*(np.array(x, np.int64) for x in (d, c, s, n)))
    by_text = suffixtree.tree_scores(data, words, model)
    each = suffixtree.log_probabilities(codes, model)
    assert by_text == pytest.approx(np.bincount(rows, each))


def test_pieces(spark, odd, odd_rows, none):
    model = pieces.load_model()
    encoded = pieces.encode(odd, model, check=True)
    got = {(r["text"], r["row"]["doc_id"]): r["ids"] for r in encoded.collect()}
    assert encoded.where("text is not null and not round_trip").count() == 0
    for (text, _), ids in got.items():
        if text is None or len(text) > 3000:
            continue
        want = pieces.encode_in_memory(text, model)
        total = lambda x: sum(model.scores[i] for i in x)
        assert ids == want or total(ids) == pytest.approx(total(want))
    back = pieces.decode(encoded.select("text", "ids"), model)
    assert all(r["decoded"] == r["row"]["text"] for r in back.collect())
    assert pieces.encode(none, model).count() == 0
    wild = spark.createDataFrame([([5, 99999999, -3, 1],), (None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in pieces.decode(wild.coalesce(1), model).collect()] == ["\x02", None, ""]


@pytest.mark.parametrize("text", ["▁literal ▁▁ marks▁", " lead", "trail ", "a\n\nb", "   ", "mixed 梦 й ⟨⟩ \U0001f600", "\x00\x01", "▁"])
def test_pieces_round_trip(spark, text):
    model = pieces.load_model()
    row = pieces.decode(pieces.encode(spark.createDataFrame([(text,)], "text string"), model), model).first()
    assert row["decoded"] == text


def test_exact_top_k(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(260)]
    rows += [(i, [0.5] * 6) for i in range(300, 420)]  # equal vectors: ties
    rows += [(500, None), (520, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (540, [float("nan")] * 6), (560, [float("inf")] * 6), (580, []), (600, [1.0, 2.0]), (None, [1.0] * 6), (620, [3.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).repartition(3)
    want = sorted(covertree.top_k_in_memory(rows, lambda i: i % 20 == 0, 20))
    for options in ({}, {"shard_bytes": 2000, "query_bytes": 500}):
        assert in_order(covertree.exact_top_k(frame, F.col("vec_id") % 20 == 0, **options).collect()) == in_order(want)
    assert covertree.exact_top_k(frame.limit(0), F.lit(True)).count() == 0


def test_cover_tree_prunes_clusters():
    rng = np.random.default_rng(3)
    centres = rng.integers(-400, 400, (40, 8))
    points = (centres[rng.integers(0, 40, 8000)] + rng.integers(-3, 4, (8000, 8))).astype(np.int64)
    ids = np.arange(8000)
    best, stats = covertree.dual_tree_search(ids[::20], points[::20], ids, points, 10)
    full = points[::20] @ points.T
    for row, i in enumerate(ids[::20]):
        order = np.lexsort((ids, -full[row]))
        assert best.id[row].tolist() == order[order != i][:10].tolist()
    assert stats["multiplied"] < 0.3 * stats["pairs"]
    tree = covertree.CoverTree(points)
    for node, (a, b) in enumerate(tree.span):
        own = points[tree.order[a:b]]
        assert np.sqrt(((own - points[tree.centre[node]]) ** 2).sum(1)).max() <= tree.radius[node] + 1e-9


def test_licences(spark, none):
    rows = [
        ("a/LICENSE", "Released under the MIT License.\n\nmore words here"), ("a/b/c/x.py", "code"), ("a/b/y.py", "# Licensed under the Apache License, Version 2.0."),
        ("z/q.txt", "nothing"), ("top.txt", None), (None, "Licensed under CC BY-NC 4.0."), ("COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/COPYING.txt", ""), ("m/LICENCE", "Released under the MIT License."), ("m/license.md", "Licensed under CC BY 4.0."), ("m/f", ""), ("a/b/c/x.py", "code"),
    ]
    files = spark.createDataFrame([(*r, "u") for r in rows], "path string, text string, licence string")
    got = licences.scan_licences(files)
    found = {r["path"]: r for r in got.collect()}
    assert got.count() == len(rows)
    for path, text in rows:
        name, score = licences.own_licence_in_memory(path, text)
        assert found[path]["own_licence"] == name and found[path]["own_score"] == pytest.approx(score)
    assert (found["a/b/c/x.py"]["licence"], found["a/b/c/x.py"]["inherited_from"]) == ("MIT", "a")
    assert found["a/b/y.py"]["licence"] == "Apache-2.0" and found["a/b/y.py"]["inherited_from"] is None
    assert (found["z/q.txt"]["licence"], found["z/q.txt"]["inherited_from"]) == ("GPL-3.0", "")
    assert found[None]["licence"] == "CC-BY-NC-4.0" and found["m/f"]["licence"] == "CC-BY-4.0"
    assert licences.scan_licences(none.withColumn("path", F.lit("x"))).count() == 0


def test_licence_notices(spark):
    """Every template, wrapped as usual in a comment or a licence file, is known as what it is; and inheritance against brute force."""
    import textwrap

    rows, want = [], {}
    for k, (name, text) in enumerate(licences.TEMPLATES):
        lines = textwrap.wrap(text, 60)
        forms = {
            f"p{k}/a.c": "/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */\nint main() { return 0; }\n", f"p{k}/b.py": "# Copyright 2020 A Person\n#\n" + "\n".join(f"# {x}" for x in lines) + "\n\nimport os\n",
            f"p{k}/sub/c.txt": "some plain words that say nothing", f"p{k}/LICENSE": "\n".join(lines) + "\n",
        }
        rows += list(forms.items())
        want |= {path: name for path in forms}
    found = {r["path"]: r for r in licences.scan_licences(spark.createDataFrame(rows, "path string, text string").repartition(3)).collect()}
    assert {p: r["licence"] for p, r in found.items()} == want
    assert sorted(licences.licences_in_memory(rows)) == sorted((r["path"], r["own_licence"], r["licence"], r["inherited_from"]) for r in found.values())


def test_classifiers_on_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(i, i % 2, None if i == 3 else i % 3 // 2) for i in range(1, 20)] + [(None, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    for function in (quality.quality, toxicity.toxicity):
        for some in (labels, labels.limit(0)):
            got = function(odd, some).collect()
            assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
            assert all(r["held_out"] is not None for r in got)
            repeated = [r for r in got if r["doc_id"] == 7]
            assert len({tuple(r) for r in repeated}) == 1
        assert function(none, labels).count() == 0
    assert quality.quality(odd, labels).collect()[0] is not None


def test_language_of_odd_rows(spark, odd, odd_rows, none):
    spoken = odd.withColumn("lang", F.when(F.col("doc_id") == 14, "xx").when(F.col("doc_id") < 12, "aa"))
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.language_id(spoken).collect()}
    assert {i for i, p in got if p == "und"} == {4, 5, 6} and len(langid.language_id(spoken).collect()) == len(odd_rows)
    assert all(0 <= r["score"] <= 1 for r in langid.language_id(spoken).collect())
    assert langid.language_id(none).count() == 0
    silent = langid.language_id(odd.withColumn("lang", F.lit(None).cast("string")))
    assert silent.where("lang_pred <> 'und' or score <> 0").count() == 0


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(7)
    scores, t, s = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got, pairs = langid.forward_backward(scores, np.array([0, 4]), t, s, want_pairs=True)
    want, joint, total = np.zeros((4, 3)), np.zeros((3, 3)), 0
    for path in itertools.product(range(3), repeat=4):
        p = np.exp(s[path[0]] + sum(scores[i, k] for i, k in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
        total += p
        for i, k in enumerate(path):
            want[i, k] += p
        for a, b in zip(path, path[1:]):
            joint[a, b] += p
    assert got == pytest.approx(want / total) and pairs == pytest.approx(joint / total)


def test_code_switching():
    rng = random.Random(1)
    left, right = ["thing", "other", "with", "hath"], ["señal", "más", "ción", "llave"]
    texts = [" ".join(rng.choice(side) for _ in range(40)) for side in (left, right) * 20]
    model = langid.fit_crf(texts, ["en", "es"] * 20)
    got = langid.label_words("thing with other hath más llave señal ción with thing", model)
    assert [x for _, x in got] == ["en"] * 4 + ["es"] * 4 + ["en"] * 2


def test_factorization_machine_learns_pairs():
    """The label is whether exactly both terms of a pair are there, which no sum of weights can say."""
    rng = np.random.default_rng(2)
    n = 3000
    has = rng.random((n, 2)) < 0.5
    noise = rng.integers(10, 40, (n, 3))
    y = (has[:, 0] ^ has[:, 1]).astype(int)
    row, bucket = [], []
    for i in range(n):
        terms = set(noise[i].tolist()) | ({1} if has[i, 0] else set()) | ({2} if has[i, 1] else set())
        row += [i] * len(terms)
        bucket += sorted(terms)
    model = toxicity.fit_machine(np.array(row), np.array(bucket), y)
    slots = model.slots[np.array(bucket)]
    keep = slots >= 0
    score = model.score(np.array(row)[keep], slots[keep].astype(np.int64), n)
    assert ((score > 0.5) == y).mean() > 0.95


def test_factorization_machine_by_definition():
    """Scores equal the sum over all pairs of terms; the gradient of one batch equals differences of the loss."""
    rng = np.random.default_rng(5)
    model = toxicity.FactorizationMachine(np.arange(20), -0.3, rng.normal(size=20), rng.normal(size=(20, 3)))
    texts = [np.flatnonzero(rng.random(20) < 0.3) for _ in range(15)] + [np.zeros(0, int)]
    row, slot = np.repeat(np.arange(16), [len(t) for t in texts]), np.concatenate(texts)
    raw = [-0.3 + model.weights[t].sum() + sum(model.factors[i] @ model.factors[j] for i in t for j in t if i < j) for t in texts]
    assert model.score(row, slot, 16) == pytest.approx(1 / (1 + np.exp(-np.array(raw))))
    first = np.searchsorted(row, np.arange(17))
    batch = toxicity._Batch(np.arange(16), first, slot)
    x, v = rng.normal(size=len(slot)), rng.normal(size=(3, len(slot)))
    assert batch.per_term(x) == pytest.approx(np.bincount(slot, x)[batch.used])
    assert batch.per_text(v) == pytest.approx(np.array([np.bincount(row, k, 16)[batch.full] for k in v]))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    lang = QUERIES["op1_language_id"](spark, folder).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    good = QUERIES["op2_quality"](spark, folder).where("held_out").join(labels, "doc_id")
    assert good.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.95
    toxic = QUERIES["op9_toxicity"](spark, folder).where("held_out").join(labels, "doc_id")
    assert toxic.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("double"))).first()[0] > 0.88


def test_folds(spark):
    got = spark.range(200).select("id", F.crc32(F.col("id").cast("string")).alias("c")).collect()
    assert all(r["c"] == zlib.crc32(str(r["id"]).encode()) for r in got)


def test_queries_over_small_tables(spark, small):
    from ..oracle import connect

    rows = connect(small).sql("SELECT doc_id, text FROM documents").fetchall()
    got = QUERIES["op10_substring_dedup"](spark, small).collect()
    assert in_order(got) == in_order(substrings.remove_repeats_in_memory(rows))
    got = QUERIES["op6_near_dedup"](spark, small).collect()
    assert in_order(got) == in_order(neardup.near_duplicates_in_memory(rows))
    items = connect(small).sql("SELECT item_id, text FROM benchmark").fetchall()
    want = [(a, b, c, d, hashlib.sha256(e.encode()).hexdigest(), f) for a, b, c, d, e, f in decontaminate.contamination_in_memory(rows, items)]
    assert in_order(QUERIES["op4_decontamination"](spark, small).collect()) == in_order(want)
    vectors = connect(small).sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    assert in_order(QUERIES["op3_exact_top_k"](spark, small).collect()) == in_order(covertree.top_k_in_memory(vectors, lambda i: i % 20 == 0, 20))
    scored = QUERIES["op5_lm_score"](spark, small)
    assert in_order([r[:5] for r in scored.collect()]) == in_order([r[:5] for r in suffixtree.base_in_memory(rows)])
    assert QUERIES["op7_sentencepiece"](spark, small).where("not round_trip").count() == 0
    assert QUERIES["op8_licence_scan"](spark, small).count() == len(rows)
