"""Quality of matches and of retrieval against true pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LinkConfig
from .decode import threshold_decode
from .index import CandidateIndex
from .retrieve import pool, probe_keys


def f05(n_true: Column, n_pred: Column, n_both: Column) -> Column:
    """Entity score: 1 or 0 for a record without true matches; else 1.25 P R / (0.25 P + R)."""
    p, r = n_both / n_pred, n_both / n_true
    return F.when(n_true == 0, (n_pred == 0).cast("double")).when((n_pred == 0) | (n_both == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def entity_f05(s1: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(s1_id, n_true, n_pred, n_both, f05) for every record of ``s1``; truth and pred are distinct pairs (s1_id, cid)."""
    pairs = truth.select("s1_id", "cid").distinct().withColumn("t", F.lit(1)).join(pred.select("s1_id", "cid").distinct().withColumn("p", F.lit(1)), ["s1_id", "cid"], "full")
    counts = pairs.groupBy("s1_id").agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.sum((F.col("t").isNotNull() & F.col("p").isNotNull()).cast("long")).alias("n_both"))
    counted = s1.select("s1_id").join(counts, "s1_id", "left").select("s1_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_true", "n_pred", "n_both")])
    return counted.withColumn("f05", f05(F.col("n_true"), F.col("n_pred"), F.col("n_both")))


def _summary() -> list[Column]:
    alone = F.col("n_true") == 0
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return [
        mean("f05").alias("macro_f05"), F.count("*").alias("total_entities"), F.sum(alone.cast("long")).alias("singleton_count"),
        mean(F.when(alone, F.col("f05"))).alias("singleton_accuracy"), F.sum((~alone).cast("long")).alias("non_singleton_count"), mean(F.when(~alone, F.col("f05"))).alias("non_singleton_f05"),
    ]


def evaluate(s1: DataFrame, truth: DataFrame, pred: DataFrame, by: str | None = None) -> DataFrame:
    """Macro F0.5 and its parts, over all or for each value of ``by`` (null: UNKNOWN)."""
    scored = entity_f05(s1, truth, pred)
    if by is None:
        return scored.agg(*_summary())
    return scored.join(s1.select("s1_id", F.coalesce(by, F.lit("UNKNOWN")).alias(by)), "s1_id").groupBy(by).agg(*_summary())


def blocking_recall(truth: DataFrame, retrieved: DataFrame) -> DataFrame:
    """One row: found and all true pairs of the records that have candidates, recall, mean number of candidates."""
    got = retrieved.select("s1_id", "cid").distinct()
    per = got.groupBy("s1_id").agg(F.count("*").alias("n"))
    true = truth.select("s1_id", "cid").distinct().join(per.select("s1_id"), "s1_id", "left_semi")
    hit = true.join(got.withColumn("hit", F.lit(1)), ["s1_id", "cid"], "left").agg(F.count("hit").alias("captured"), F.count("*").alias("total_pairs"))
    mean = per.agg(F.round(F.avg("n"), 6).alias("avg_candidates"), F.count("*").alias("n_entities"))
    return hit.crossJoin(mean).withColumn("recall", F.round(F.when(F.col("total_pairs") > 0, F.col("captured") / F.col("total_pairs")).otherwise(0.0), 6))  # one row each


def miss_reasons(truth: DataFrame, s1: DataFrame, index: CandidateIndex, all_postings: DataFrame, ranked: DataFrame) -> DataFrame:
    """(s1_id, cid, country, reason) of every true pair, by the first reason that holds.

    ``ranked`` are the retrieved pairs after truncation, ``all_postings`` the keys before the cap.
    """
    pairs = truth.select("s1_id", "cid").distinct().join(s1.select("s1_id", "country"), "s1_id")
    cand = index.candidates.select("cid", F.col("country").alias("c_country"))
    top = ranked.select("s1_id", "cid").distinct().withColumn("top", F.lit(1))
    whole = pool(s1, index).select("s1_id", "cid", F.lit(1).alias("pooled"))
    mine = probe_keys(s1, index).select("s1_id", "country", "key").distinct()
    theirs = all_postings.select("cid", "country", "key").distinct()
    asked = pairs.select("s1_id", "cid", "country")  # key lists of the true pairs alone, never all pairs of a key
    shared = asked.join(mine, ["s1_id", "country"]).join(theirs, ["cid", "country", "key"], "left_semi").select("s1_id", "cid").distinct().withColumn("common", F.lit(1))
    joined = pairs.join(cand, "cid", "left").join(top, ["s1_id", "cid"], "left").join(whole, ["s1_id", "cid"], "left").join(shared, ["s1_id", "cid"], "left")
    reason = (
        F.when(F.col("top") == 1, "HIT").when(F.col("c_country").isNull(), "cand_not_in_index").when(F.col("c_country") != F.col("country"), "country_mismatch")
        .when(F.col("pooled") == 1, "retrieved_but_ranked_out").when(F.col("common") == 1, "shared_keys_all_capped").otherwise("no_shared_key")
    )
    return joined.select("s1_id", "cid", "country", reason.alias("reason"))


def nearest_rank(values: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """(name, value): exact percentiles by the place int(n * share) of the sorted values, and the maximum.

    Values are counted first, so only distinct values are ordered, however many rows there are.
    """
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    running = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    total = values.agg(F.count("*").alias("t"))
    wanted = values.sparkSession.createDataFrame([(f"p{round(s * 100)}", float(s)) for s in shares] + [("max", 1.0)], "name string, share double")
    place = wanted.crossJoin(total).withColumn("place", F.least((F.col("t") * F.col("share")).cast("long"), F.col("t") - 1))  # a few rows
    return running.crossJoin(F.broadcast(place)).where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place"))).select("name", F.col("v").alias("value"))


def threshold_sweep(s1: DataFrame, truth: DataFrame, scores: DataFrame, grid: tuple[float, ...], groups: DataFrame | None = None) -> DataFrame:
    """(threshold, macro_f05, best) in one pass: a pair counts for every threshold up to its probability.

    ``groups`` has a few rows of further columns of ``scores``: each of them is a sweep of its own, also without scores.
    """
    each, by = F.array(*[F.lit(float(t)) for t in grid]), groups.columns if groups is not None else []
    pairs = scores.select("s1_id", "cid", "prob", *by).join(truth.select("s1_id", "cid").distinct().withColumn("t", F.lit(1)), ["s1_id", "cid"], "left")
    hits = pairs.select("s1_id", "t", *by, F.explode(F.filter(each, lambda x: F.col("prob") >= x)).alias("threshold")).groupBy("s1_id", *by, "threshold").agg(F.count("*").alias("n_pred"), F.count("t").alias("n_both"))
    true = s1.select("s1_id").join(truth.select("s1_id", "cid").distinct().groupBy("s1_id").agg(F.count("*").alias("n_true")), "s1_id", "left")
    true = true.crossJoin(F.broadcast(groups)) if by else true  # a few rows
    rows = true.select("*", F.explode(each).alias("threshold")).join(hits, ["s1_id", *by, "threshold"], "left").select(*by, "threshold", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_true", "n_pred", "n_both")])
    macro = rows.groupBy(*by, "threshold").agg(F.round(F.avg(f05(F.col("n_true"), F.col("n_pred"), F.col("n_both"))), 6).alias("macro_f05"))
    best = macro.groupBy(*by).agg(F.min(F.struct((-F.col("macro_f05")).alias("m"), "threshold")).alias("b"))  # the first of equal ones
    joined = macro.join(best, by) if by else macro.crossJoin(best)
    return joined.select(*by, "threshold", "macro_f05", (F.col("threshold") == F.col("b.threshold")).alias("best"))


def match_volume(s1: DataFrame, matches: DataFrame) -> DataFrame:
    """(country, n_entities, n_matches, matches_per_entity, empty_rate)."""
    per = s1.select("s1_id", "country").join(matches.groupBy("s1_id").agg(F.count("*").alias("n")), "s1_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return per.groupBy("country").agg(F.count("*").alias("n_entities"), F.sum("n").alias("n_matches"), F.round(F.avg("n"), 6).alias("matches_per_entity"), F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("empty_rate"))
