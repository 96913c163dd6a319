"""A corpus pipeline of five stages over ``documents``; each keeps what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and reread as the next one's
``docs``.  All but the last return the columns of ``documents``, whatever their names.  Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.llm.decontaminate import decontaminate
from kinforge.llm.frames import table
from kinforge.llm.neardup import near_duplicates
from kinforge.llm.pieces import encode, load_model
from kinforge.llm.quality import fit_quality, score_quality
from kinforge.llm.substrings import remove_repeats


def _columns(got: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of ``docs`` from a frame of doc_id, text and, if there are others, ``row``."""
    own = {c: F.col(f"`{c}`") if c in ("doc_id", "text") else F.col(f"row.`{c}`") for c in docs.columns} | changed
    return got.select(*[own[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of these documents, does not reject; all, if no two classes were learned.

    Null and empty texts are judged like any other, a null id too (it is never learned from); repeated rows fare alike.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    if len(model.classes) < 2:
        return docs
    scored = score_quality(docs, model, keep=True)
    return _columns(scored.where("predicted = 1"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near duplicates.

    Documents without words and rows with a null id are in no group and stay.  Rows that repeat an id are one document and
    stay or go together.
    """
    return docs.join(near_duplicates(docs).where("not kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller id holds; texts without such a passage are unchanged.

    No row goes.  Null texts stay null; a row with a null id keeps its text and takes none from others; rows that repeat an
    id take nothing from each other.
    """
    got = remove_repeats(docs)
    cut = F.col("n_removed") > 0
    changed = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("kept_text")).otherwise(F.col("row.n_chars"))
    return _columns(got, docs, **changed)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, judged row by row; null and empty texts never are."""
    return _columns(decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated"), docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids (null for a null text), and whether the ids decode to the text.

    If ``docs`` has columns of these names, the new ones are called piece_ids and piece_round_trip, and so on.
    """
    got = encode(docs, load_model(), check=True)
    own = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        return name if name not in taken else free(f"piece_{name}")

    return got.select(*[x.alias(c) for x, c in zip(own, docs.columns)], F.col("ids").alias(free("ids")), F.col("round_trip").alias(free("round_trip")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: The classifier and the piece segmentation are not SQL; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  Each stage's Parquet is a table of the warehouse, dropped when the next one is written."""
    docs, run_id = table(spark, sf_dir, "documents"), uuid.uuid4().hex
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.format("parquet").saveAsTable(f"pipeline_{run_id}_{k}")
        docs = spark.table(f"pipeline_{run_id}_{k}")
        if k:
            spark.sql(f"DROP TABLE pipeline_{run_id}_{k - 1}")
    return docs
