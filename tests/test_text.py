"""Normalization, skeletons, transliteration and similarity kernels on hand-written values."""

import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinforge.functions import kernels as kn
from kinforge.functions import text as tx


def apply(spark, function, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select(function(F.col("v")).alias("o"), "i").orderBy("i").collect()]


def name(v):
    return tx.normalize_name(tx.strip_latin_accents(v))


def test_names(spark):
    cases = {
        "Borealis Corp. LLC": "borealis", "  Quillfern Inc. ": "quillfern", "Kaveri Looms Pvt Ltd": "kaveri looms", "Société du Vélo SAS": "societe du velo",
        "ÉTOILE BLEUE SAS": "etoile bleue", "Etoile Bleue S.A.S.": "etoile bleue", "Moulin Vert S.C.I": "moulin vert", "": "", "Ltd Co": "",
        "a b c d e f g": "abcdef g", "Limited Liability Partnership": "liability partnership", "R&D co": "r&d", "pvtltd x": "x", "co-op": "op", "Œuvre Fine": "œuvre fine",
    }
    assert apply(spark, name, *cases) == list(cases.values())


def test_addresses(spark):
    address = lambda v: tx.normalize_address(tx.strip_latin_accents(v))
    cases = {"19 N. Mill St., Suite 7": "19 n mill street suite 7", "5 R de la Paix, Bd X": "5 rue de la paix boulevard x", "a&r st": "a&rue street", "##16 PO": "16 po", "": ""}
    assert apply(spark, address, *cases) == list(cases.values())


def test_numbers(spark):
    got = apply(spark, tx.extract_numbers, "300 Canal Pkwy, Bldg 4, Ste 20", "12b 12_34", "", None, "५६ x", "7 7")
    assert got == [["20", "300", "4"], [], [], [], ["५६"], ["7"]]


def test_accents_of_latin_text_equal_the_general_way(spark):
    chars = [chr(c) for c in [*range(0x20, 0x250), *range(0x1E00, 0x1F00)] if unicodedata.category(chr(c))[0] != "C"]
    chars = [c for c, hard in zip(chars, apply(spark, tx.needs_unicode, *chars)) if not hard]
    assert len(chars) > 700 and apply(spark, tx.needs_unicode, "a", "é", "½", "न", "ﬁ", "e\u0301") == [False, False, True, True, True, True]
    assert apply(spark, tx.strip_latin_accents, *chars) == apply(spark, tx.strip_accents, *chars)
    assert apply(spark, tx.strip_accents, "é नि", "ｆｕｌｌ", None) == ["e नि", "full", ""]


def test_skeletons(spark):
    pairs = [("global", "ग्लोबल"), ("healthcare", "हेल्थकेयर")]
    assert apply(spark, tx.phonetic_skeleton, *[p[0] for p in pairs]) == apply(spark, tx.phonetic_skeleton, *[p[1] for p in pairs])
    assert apply(spark, tx.phonetic_skeleton, "", "city", "apple", "अमन", "क!2") == ["", "st", "apl", "amn", "k2"]


def test_spelling(spark):
    cases = {"ग्लोबल": "global", "प्राइवेट": "praivet", "भवन": "bhavan", "अंक": "anka"[:3], "abc": "abc", "": "", "ज़": "j", "क्": "k", "दुःख": "duhkh", "ABC": "abc"}
    got = dict(zip(cases, apply(spark, tx.transliterate_token, *cases)))
    assert got["ग्लोबल"] == "global" and got["प्राइवेट"] == "praivet" and got["भवन"] == "bhavan" and got["ABC"] == "abc" and got["क्"] == "k" and got["दुःख"] == "duhkh"


def test_ngrams(spark):
    assert apply(spark, lambda v: tx.token_ngrams(tx.tokens(v)), "a b c", "a", "") == [["a b", "b c"], ["a"], []]
    assert [sorted(x) for x in apply(spark, tx.char_ngrams, "ab cd", "ab", "")] == [["abc", "bcd"], ["ab"], []]


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert kn.common_subsequence(a, b) == table[-1][-1]
    assert kn.ratio(a, b) == kn.ratio(b, a)


@given(st.text("abcd", max_size=8), st.text("abcd", max_size=8))
def test_partial_ratio_is_the_best_window(a, b):
    short, long = sorted((a, b), key=len)
    windows = [long[max(s, 0) : s + len(short)] for s in range(1 - len(short), len(long))]
    want = float(short == long) if not short or not long else max(kn.ratio(short, w) for w in windows)
    assert kn.partial_ratio(a, b) == pytest.approx(want)


def test_kernel_values():
    assert kn.ratio("", "") == 1 and kn.ratio("a", "") == 0
    assert kn.token_sort_ratio("b a", "a b") == 1
    assert kn.token_set_ratio("a b", "a b c") == 1 and kn.token_set_ratio("", "a") == 0
    assert kn.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert kn.jaro_winkler("", "") == 1 and kn.jaro_winkler("a", "") == 0
