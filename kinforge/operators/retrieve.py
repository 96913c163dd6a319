"""Candidate retrieval: equality passes, the key join, weighted pools, and the rerank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions.kernels import set_kernel
from ..functions.text import extract_numbers
from .index import CandidateIndex
from .keys import blocking_keys


def best(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order, numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def equality_pass(s1: DataFrame, candidates: DataFrame, column: str, weight: float, limit: int) -> DataFrame:
    """(s1_id, cid, weight): candidates of the country with the same non-empty ``column``, at most ``limit`` by cid.

    All rows of one (country, value) ask for the same first cids, so the candidates are cut to limit + 0 per value
    before the join: its fan-out is bounded by the limit.
    """
    values = candidates.where(F.col(column) != "").select("country", column, "cid")
    values = best(values, ["country", column], ["cid"], limit).drop("rank")
    return s1.where(F.col(column) != "").select("s1_id", "country", column).join(values, ["country", column]).select("s1_id", "cid", F.lit(weight).alias("weight"))


def key_pass(probe: DataFrame, postings: DataFrame) -> DataFrame:
    """(s1_id, cid, weight): summed weights of the shared keys.  Postings are capped, so no key fans out widely."""
    return probe.join(postings.select("country", "key", "cid"), ["country", "key"]).groupBy("s1_id", "cid").agg(F.sum("weight").alias("weight"))


def probe_keys(s1: DataFrame, index: CandidateIndex) -> DataFrame:
    return blocking_keys(s1, "s1_id", index.df, index.config)


def pool(s1: DataFrame, index: CandidateIndex) -> DataFrame:
    """(s1_id, cid, weight) over all three passes."""
    c = index.config
    passes = [
        equality_pass(s1, index.candidates, "norm_name", c.exact_weight, c.name_matches),
        equality_pass(s1, index.candidates, "comp_name", c.compressed_weight, c.name_matches),
        key_pass(probe_keys(s1, index), index.postings),
    ]
    return passes[0].unionByName(passes[1]).unionByName(passes[2]).groupBy("s1_id", "cid").agg(F.sum("weight").alias("weight"))


def attach(pairs: DataFrame, s1: DataFrame, candidates: DataFrame) -> DataFrame:
    """Texts of both sides, joined after the pairs are few: s1_* and cand_* columns."""
    cols = ("name", "addr", "norm_name", "norm_addr")
    left = s1.select("s1_id", "country", *[F.col(c).alias(f"s1_{c}") for c in cols])
    right = candidates.select("cid", *[F.col(c).alias(f"cand_{c}") for c in cols])
    return pairs.join(left, "s1_id").join(right, "cid")


def rerank_score(name_set: Column, addr_set: Column, shared_number: Column, weight: Column) -> Column:
    """Text similarity on a scale of 100, a bonus for a shared number, and a hundredth of the key weight."""
    return 55 * name_set + 35 * addr_set + F.when(shared_number, 10.0).otherwise(0.0) + 0.01 * weight


def rerank(pairs: DataFrame, k: int) -> DataFrame:
    """Attached pairs with weight: the best k of each s1_id by the rerank score, ties to the smaller cid."""
    shared = F.arrays_overlap(extract_numbers(F.col("s1_norm_addr")), extract_numbers(F.col("cand_norm_addr")))
    kernels = pairs.withColumns({"_n": set_kernel(F.col("s1_norm_name"), F.col("cand_norm_name"))[0], "_a": set_kernel(F.col("s1_norm_addr"), F.col("cand_norm_addr"))[0]})
    scored = kernels.withColumn("score", rerank_score(F.col("_n"), F.col("_a"), F.coalesce(shared, F.lit(False)), F.col("weight"))).drop("_n", "_a")
    return best(scored, ["s1_id"], [F.desc("score"), "cid"], k)


def retrieve(s1: DataFrame, index: CandidateIndex, by_text: bool = True) -> DataFrame:
    """Ranked candidates with the texts of both sides; without ``by_text``, ranked by the weights alone."""
    c: LinkConfig = index.config
    heaviest = best(pool(s1, index), ["s1_id"], [F.desc("weight"), "cid"], c.rerank_pool if by_text else c.max_candidates)
    attached = attach(heaviest.drop("rank") if by_text else heaviest, s1, index.candidates)
    return rerank(attached, c.max_candidates) if by_text else attached


def candidate_lists(s1: DataFrame, ranked: DataFrame) -> DataFrame:
    """(s1_id, candidate_ids): comma-joined in rank order, '' for none.  A list has max_candidates entries at most."""
    joined = ranked.groupBy("s1_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cid"))), lambda x: x["cid"]), ",").alias("candidate_ids"))
    return s1.select("s1_id").join(joined, "s1_id", "left").select("s1_id", F.coalesce("candidate_ids", F.lit("")).alias("candidate_ids"))
