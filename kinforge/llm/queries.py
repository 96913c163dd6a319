"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .covertree import exact_top_k
from .decontaminate import decontaminate
from .frames import table
from .langid import language_id
from .licences import scan_licences
from .neardup import near_duplicates
from .pieces import encode, load_model
from .quality import quality
from .sql import ORACLES
from .substrings import remove_repeats
from .suffixtree import score_lm
from .toxicity import toxicity


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_lm(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, and whether the decoded ids are the text."""
    got = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), load_model(), check=True)
    return got.select("row.doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", "round_trip")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no paths, so this lays the rows out as files: source/lang/package/name, where every seventh document is its package's licence file."""
    name = F.when(F.col("doc_id") % 7 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("p"), (F.col("doc_id") % 64).cast("string")), name)
    got = scan_licences(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))
    return got.select("row.doc_id", "path", "own_licence", "own_score", "licence", "inherited_from")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_quality, op3_exact_top_k, op4_decontamination, op5_lm_score, op6_near_dedup, op7_sentencepiece, op8_licence_scan, op9_toxicity, op10_substring_dedup, pipeline)}
