"""Decisions per reference record: which of its scored candidates match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade_blend(screener: Column, specialist: Column, low: float = 0.20, high: float = 0.88, share: float = 0.7) -> Column:
    """The screener's probability, blended with the specialist's in the band [low, high)."""
    return F.when((screener >= low) & (screener < high), share * screener + (1 - share) * specialist).otherwise(screener)


def name_floor_gate(prob: Column, name_set: Column, floor: float | Column) -> Column:
    """No match below a similarity of the names."""
    return F.when(name_set < floor, 0.0).otherwise(prob)


def threshold_decode(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.where(F.col("prob") >= threshold).select("s1_id", "cid", "prob")


def above_floor(scores: DataFrame, floor: float = 0.70) -> DataFrame:
    """Scores of the records whose best probability reaches the floor."""
    return scores.withColumn("top", F.max("prob").over(Window.partitionBy("s1_id"))).where(F.col("top") >= floor).drop("top")


def _decided(scores: DataFrame, floor: float, beta2: float) -> DataFrame:
    """Adds place (by probability, then rank), k and n.  One shuffle; a record has max_candidates rows at most."""
    whole = Window.partitionBy("s1_id")
    order = whole.orderBy(F.desc("prob"), "rank")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = scores.select(
        "*", F.row_number().over(order).alias("place"), F.sum("prob").over(upto).alias("_s"), F.sum("prob").over(every).alias("_t"),
        F.max("prob").over(every).alias("_top"), F.product(1 - F.col("prob")).over(every).alias("_none"), F.count("*").over(every).alias("n"),
    )
    f = (1 + beta2) * F.col("_s") / (beta2 * F.col("_t") + F.col("place"))
    best = sums.withColumn("_best", F.max(F.struct(f.alias("f"), (-F.col("place")).alias("k"))).over(every))
    k = F.when((F.col("_top") < floor) | (F.col("_none") >= F.col("_best.f")), 0).otherwise(-F.col("_best.k")).cast("int")
    return best.withColumn("k", k).select(*scores.columns, "place", "k", "n")


def expected_f05_decode(scores: DataFrame, floor: float = 0.70, beta2: float = 0.25) -> DataFrame:
    """(s1_id, k, n): how many of a record's best candidates maximise the expected F score.

    With S_k the sum of the k best probabilities of n: f_k = (1 + beta2) S_k / (beta2 S_n + k), and f_0 is the
    probability that none matches.  A maximum below the floor decides for none; ties take the smaller k.
    """
    return _decided(scores, floor, beta2).where("place = 1").select("s1_id", "k", "n")


def decode_all(s1: DataFrame, scores: DataFrame, floor: float = 0.70) -> DataFrame:
    """(s1_id, cid, prob): the accepted pairs."""
    return _decided(scores, floor, 0.25).where("place <= k").join(s1.select("s1_id"), "s1_id", "left_semi").select("s1_id", "cid", "prob")


def resolve_winners(scores: DataFrame) -> DataFrame:
    """(cid, s1_id, prob): the record that scored each candidate highest; ties go to the smaller s1_id."""
    return scores.groupBy("cid").agg(F.min(F.struct((-F.col("prob")).alias("p"), "s1_id")).alias("w")).select("cid", F.col("w.s1_id").alias("s1_id"), (-F.col("w.p")).alias("prob"))


def dedupe_matches(matches: DataFrame, scores: DataFrame) -> DataFrame:
    """(s1_id, cid): accepted pairs whose candidate no other record scored higher; candidates never scored stay.

    All scored pairs count, also those that their record did not accept.
    """
    owner = resolve_winners(scores).select("cid", F.col("s1_id").alias("owner"))
    return matches.select("s1_id", "cid").join(owner, "cid", "left").where(F.col("owner").isNull() | (F.col("owner") == F.col("s1_id"))).select("s1_id", "cid")


def match_lists(s1: DataFrame, matches: DataFrame) -> DataFrame:
    """(s1_id, matched_ids): sorted and comma-joined, '' for none, one row for every record."""
    lists = matches.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cid")), ",").alias("matched_ids"))
    return s1.select("s1_id").join(lists, "s1_id", "left").select("s1_id", F.coalesce("matched_ids", F.lit("")).alias("matched_ids"))
