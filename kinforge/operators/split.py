"""Sampling and splitting by a hash of the id: reproducible, and independent of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col)))


def split_entities(ids: DataFrame, id_col: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """(id, part): ``val`` if the first 8 hex digits of the hash fall below the share, else ``train``."""
    bucket = F.conv(F.substring(hash_order(id_col, seed), 1, 8), 16, 10).cast("long")
    return ids.select(id_col).distinct().select(id_col, F.when(bucket < int(share * (1 << 32)), "val").otherwise("train").alias("part"))


def hash_sample(ids: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """The n ids of the smallest hash."""
    return ids.select(id_col).distinct().orderBy(hash_order(id_col, seed), id_col).limit(n)


def positive_sample(truth: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n records with a true match."""
    return hash_sample(truth, "s1_id", n, seed)


def train_ids(truth_ids: DataFrame, val_ids: DataFrame, id_col: str, n: int) -> DataFrame:
    """The first n ids, by hash, that are not validation ids."""
    return hash_sample(truth_ids.join(val_ids.select(id_col), id_col, "left_anti"), id_col, n, 42)


def keep_ids(entities: DataFrame, ids: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Rows whose id is listed."""
    return entities.join(ids.select(id_col).distinct(), id_col, "left_semi")


def sample_negatives(pairs: DataFrame, ratio: int | None, least: int = 10) -> DataFrame:
    """All positives, and of each record's negatives the first max(ratio * positives, least) by rank; None or 0 keeps all.

    ``pairs`` has s1_id, rank, label and n_true (the record's true matches).
    """
    if not ratio:
        return pairs
    place = F.row_number().over(Window.partitionBy("s1_id", "label").orderBy("rank"))
    kept = pairs.withColumn("_p", place).where((F.col("label") == 1) | (F.col("_p") <= F.greatest(F.col("n_true") * ratio, F.lit(least))))
    return kept.drop("_p")
