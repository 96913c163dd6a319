"""Registered linkage queries cover every ranked pair."""

from kinforge.plans import catalog


def test_features_of_all_ranked_pairs(spark, small):
    want = catalog.QUERIES["label_pairs"](spark, small).select("s1_id", "cid")
    got = catalog.QUERIES["pair_features"](spark, small).select("s1_id", "cid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
