"""The candidate index: normalized candidates, document frequencies, and capped postings."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions.text import compressed_name, needs_unicode, normalize_address, normalize_name, strip_accents, strip_latin_accents
from .keys import blocking_keys, document_frequency


def normalize_entities(entities: DataFrame, full_unicode: bool = True) -> DataFrame:
    """entity_id, name, addr, country, norm_name, norm_addr, comp_name.

    Rows of Latin letters alone stay in the JVM; only the others pass through the Arrow function.
    """
    raw = entities.select("entity_id", F.coalesce("business_name", F.lit("")).alias("name"), F.coalesce("business_address", F.lit("")).alias("addr"), F.coalesce("country", F.lit("")).alias("country"))
    other = needs_unicode(F.col("name")) | needs_unicode(F.col("addr"))
    folded = raw.where(~other).withColumns({"_n": strip_latin_accents(F.col("name")), "_a": strip_latin_accents(F.col("addr"))}) if full_unicode else raw.withColumns({"_n": strip_latin_accents(F.col("name")), "_a": strip_latin_accents(F.col("addr"))})
    if full_unicode:
        folded = folded.unionByName(raw.where(other).withColumns({"_n": strip_accents(F.col("name")), "_a": strip_accents(F.col("addr"))}))
    done = folded.withColumns({"norm_name": normalize_name(F.col("_n")), "norm_addr": normalize_address(F.col("_a"))})
    return done.select("entity_id", "name", "addr", "country", "norm_name", "norm_addr", compressed_name(F.col("norm_name")).alias("comp_name"))


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of the candidate sources."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more)
    return out


def first_of_each_id(entities: DataFrame) -> DataFrame:
    """One row for every entity_id: the smallest of its rows by content.

    Applied to normalized records, so that all users of a table read one shuffle of finished columns.
    """
    rest = [c for c in entities.columns if c != "entity_id"]
    kept = entities.groupBy("entity_id").agg(F.min(F.struct(*rest)).alias("r"))
    return kept.select("entity_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def kept(df: DataFrame, config: LinkConfig) -> DataFrame:
    """Persisted in memory and on disk, if the settings ask for it; a lost part is computed again.

    With ``cut`` the table is a checkpoint instead, where the session has a folder for it or is a single process.
    """
    if config.persist and config.cut:
        context = df.sparkSession.sparkContext
        if context._jsc.sc().getCheckpointDir().isDefined():
            return df.checkpoint()
        if re.match(r"local(\[|$)", context.master):
            return df.localCheckpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK) if config.persist else df


def hot_keys(postings: DataFrame, cap: int) -> DataFrame:
    """(country, key, n) of the keys held by more than ``cap`` candidates."""
    return postings.groupBy("country", "key").agg(F.count("*").alias("n")).where(F.col("n") > cap)


def cap_postings(postings: DataFrame, cap: int) -> DataFrame:
    """Postings without the hot keys."""
    return postings.join(hot_keys(postings, cap), ["country", "key"], "left_anti")


@dataclass(frozen=True)
class CandidateIndex:
    candidates: DataFrame  # cid, name, addr, country, norm_name, norm_addr, comp_name
    df: DataFrame  # country, token, df
    postings: DataFrame  # cid, country, key, weight; capped
    config: LinkConfig

    def save(self, folder: str) -> None:
        """Write the three tables as Parquet, postings clustered by key."""
        self.candidates.write.mode("overwrite").parquet(f"{folder}/candidates")
        self.df.write.mode("overwrite").parquet(f"{folder}/df")
        self.postings.repartition("country", "key").sortWithinPartitions("country", "key").write.mode("overwrite").parquet(f"{folder}/postings")

    @staticmethod
    def load(spark: SparkSession, folder: str, config: LinkConfig = LinkConfig()) -> CandidateIndex:
        return CandidateIndex(*(spark.read.parquet(f"{folder}/{t}") for t in ("candidates", "df", "postings")), config)


def build_index(sources: list[DataFrame], config: LinkConfig = LinkConfig(), translit=None) -> CandidateIndex:
    """Index of the union of the candidate sources; ``translit`` rewrites the candidates' texts first."""
    entities = union_sources(*sources)
    if translit is not None:
        entities = translit(first_of_each_id(entities))
    candidates = first_of_each_id(normalize_entities(entities)).withColumnRenamed("entity_id", "cid")
    candidates = kept(candidates, config)
    df = document_frequency(candidates)
    return CandidateIndex(candidates, df, cap_postings(blocking_keys(candidates, "cid", df, config), config.posting_cap), config)


def index_stats(index: CandidateIndex) -> DataFrame:
    """One row: candidates, address words, postings, and postings for each candidate."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    row = n(index.candidates, "n_candidates").crossJoin(n(index.df, "n_tokens")).crossJoin(n(index.postings, "n_postings"))  # one row each
    return row.withColumn("keys_per_candidate", F.round(F.col("n_postings") / F.col("n_candidates"), 6))


def lookup(index: CandidateIndex, cids: DataFrame) -> DataFrame:
    """Candidates of the given ids (cid)."""
    return index.candidates.join(cids.select("cid").distinct(), "cid", "left_semi")
