"""The whole linkage as one plan: normalize, index, retrieve, score, decide, resolve owners."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions.similarity import FEATURES, with_features
from ..operators.decode import decode_all, dedupe_matches, match_lists, threshold_decode
from ..operators.evaluate import evaluate
from ..operators.index import CandidateIndex, build_index, first_of_each_id, kept, normalize_entities
from ..operators.retrieve import candidate_lists, retrieve
from ..operators.split import split_entities
from ..operators.training import Cascade, fit_cascade, training_pairs
from ..operators.translit import apply_dictionary

Scorer = Callable[[DataFrame], DataFrame]


def surrogate_score(pairs: DataFrame) -> DataFrame:
    """Adds prob: the mean of the three Jaccard features.  It needs no model, so whole plans can be checked exactly."""
    return pairs.withColumn("prob", F.round((F.col("name_jaccard") + F.col("addr_jaccard") + F.col("num_jaccard")) / 3, 4))


def reference_records(entities: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """Normalized records of the reference source, keyed by s1_id; their texts are not transliterated."""
    return kept(first_of_each_id(normalize_entities(entities)).withColumnRenamed("entity_id", "s1_id"), config)


def first_records(records: DataFrame, most: int | None, chunk: int = 4000) -> DataFrame:
    """A trial run's records: the smallest s1_ids, as many as ``most`` rounded up to whole chunks; None: all."""
    return records if most is None else records.orderBy("s1_id").limit(-(-most // chunk) * chunk)


@dataclass(frozen=True)
class Linkage:
    s1: DataFrame
    index: CandidateIndex
    ranked: DataFrame  # s1_id, cid, rank, texts of both sides
    scores: DataFrame  # s1_id, cid, rank, prob
    accepted: DataFrame  # before owners are resolved
    matches: DataFrame  # s1_id, cid

    def lists(self) -> DataFrame:
        """One row for every reference record: s1_id, matched_ids."""
        return match_lists(self.s1, self.matches)

    def candidates(self) -> DataFrame:
        return candidate_lists(self.s1, self.ranked)

    def release(self) -> None:
        """Give up the persisted tables."""
        for df in (self.s1, self.index.candidates, self.scores):
            df.unpersist()

    def evaluate(self, truth: DataFrame, by: str | None = None) -> DataFrame:
        return evaluate(self.s1, truth, self.matches, by)


def _decide(records: DataFrame, index: CandidateIndex, ranked: DataFrame, scores: DataFrame, config: LinkConfig, threshold: float | None = None) -> Linkage:
    accepted = decode_all(records, scores, config.confidence_floor) if threshold is None else threshold_decode(scores, threshold)
    return Linkage(records, index, ranked, scores, accepted, dedupe_matches(accepted, scores))


def _rewrite(dictionary: DataFrame | None):
    return (lambda e: apply_dictionary(e, dictionary)) if dictionary is not None else None


def link(s1: DataFrame, sources: list[DataFrame], scorer: Scorer = surrogate_score, config: LinkConfig = LinkConfig(), dictionary: DataFrame | None = None, kernels: bool = True, index: CandidateIndex | None = None, threshold: float | None = None, most: int | None = None, chunk: int = 4000) -> Linkage:
    """Link the records of ``s1`` to those of ``sources`` (entity_id, business_name, business_address, country).

    ``dictionary`` (word, latin) rewrites Indic words of the candidates; an ``index`` built before can be given instead
    of building one.  Without ``kernels`` the plan runs in the JVM alone, ranks by key weights and uses the plain features.
    A ``threshold`` takes the place of the expected-F0.5 decision; ``most`` and ``chunk`` as in ``first_records``.
    """
    records, index = first_records(reference_records(s1, config), most, chunk), index or build_index(sources, config, _rewrite(dictionary))
    ranked = retrieve(records, index, by_text=kernels)
    scores = kept(scorer(with_features(ranked, kernels)).select("s1_id", "cid", "rank", "prob"), config)
    return _decide(records, index, ranked, scores, config, threshold)


def train_and_link(s1: DataFrame, sources: list[DataFrame], truth: DataFrame, config: LinkConfig = LinkConfig(), dictionary: DataFrame | None = None, seed: int = 42) -> tuple[Linkage, Cascade]:
    """Fit the cascade on the true pairs of the training part (``split_entities``) and link all records with it.

    The features of the ranked pairs are made once, for training and scoring; they and the other kept tables are cut
    from their lineage.
    """
    config = replace(config, cut=True)
    records, index = reference_records(s1, config), build_index(sources, config, _rewrite(dictionary))
    ranked = retrieve(records, index)
    featured = kept(with_features(ranked).select("s1_id", "cid", "rank", "country", *FEATURES), config)
    train = split_entities(records, "s1_id", seed=seed).where("part = 'train'")
    pairs = kept(training_pairs(featured, truth, records, index.candidates).join(train.select("s1_id"), "s1_id", "left_semi"), config)
    cascade = fit_cascade(pairs, config)
    pairs.unpersist()
    scores = kept(cascade.score(featured).select("s1_id", "cid", "rank", "prob"), config)
    return _decide(records, index, ranked, scores, config), cascade
