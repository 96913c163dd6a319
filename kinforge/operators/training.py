"""Training pairs, and the two-model cascade over all pairs."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions.similarity import FEATURES, with_features
from . import models
from .decode import cascade_blend, name_floor_gate
from .evaluate import threshold_sweep
from .index import union_sources
from .models import Network, Trees
from .retrieve import attach
from .split import sample_negatives

HELD_SHARE = 0.1  # of all pairs, for the specialist's early stop

# --- Fixed values: the tuner's settings -------------------------------------------------------------------------
SEARCH_SPACE = {
    "leaves": [31, 63, 95, 127],
    "rate": [0.03, 0.05, 0.08, 0.12],
    "depth": [6, 8, 10, -1],
    "features": [0.7, 0.8, 0.85, 0.9, 1.0],
    "rows": [0.7, 0.8, 0.85, 0.9, 1.0],
    "least": [10, 20, 30, 50],
}
NAME_FLOORS = (0.0, 0.15, 0.25, 0.35)
# ------------------------------------------------------------------------------------------------------------------


def label_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds label: 1 for a true pair, else 0."""
    true = truth.select("s1_id", "cid").distinct().withColumn("label", F.lit(1))
    return pairs.join(true, ["s1_id", "cid"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def missed_positives(truth: DataFrame, retrieved: DataFrame, s1: DataFrame, candidates: DataFrame) -> DataFrame:
    """True pairs that were not retrieved but whose candidate exists, attached."""
    lost = truth.select("s1_id", "cid").distinct().join(retrieved.select("s1_id", "cid"), ["s1_id", "cid"], "left_anti")
    return attach(lost, s1, candidates)


def training_pairs(ranked: DataFrame, truth: DataFrame, s1: DataFrame, candidates: DataFrame, ratio: int | None = 5, inject: bool = True, kernels: bool = True) -> DataFrame:
    """Ranked attached pairs (and missed true ones) with label and features, negatives capped for each record.

    ``ranked`` may have its features already, and then needs no texts.
    """
    ready = set(FEATURES) <= set(ranked.columns)
    cols = ["s1_id", "cid", "country", *(FEATURES if ready else [f"{side}_{c}" for side in ("s1", "cand") for c in ("name", "addr", "norm_name", "norm_addr")])]
    pairs = ranked.select(*cols, "rank")
    if inject:
        missed = missed_positives(truth, ranked, s1, candidates)
        pairs = pairs.unionByName((with_features(missed, kernels) if ready else missed).select(*cols, F.lit(1 << 30).alias("rank")))
    n_true = truth.select("s1_id", "cid").distinct().groupBy("s1_id").agg(F.count("*").alias("n_true"))
    labelled = label_pairs(pairs, truth).join(n_true, "s1_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))
    some = sample_negatives(labelled, ratio)
    return some if ready else with_features(some, kernels)


def _hashed(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.xxhash64("s1_id", "cid").alias("_h"), "s1_id", "cid", *[F.col(c).cast("double").alias(c) for c in (*FEATURES, "label")])


def feature_rows(pairs: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels on the driver, in the order of a hash of the pair, for a look at a small table; no model learns from
    these.  With ``most``, of more pairs about that many."""
    hashed = _hashed(pairs)
    if most is not None and (n := pairs.count()) > most:
        hashed = hashed.where(F.col("_h") < int((2 * most / n - 1) * (1 << 63)))  # a share of the hash's range
    table = hashed.toArrow().sort_by([(c, "ascending") for c in ("_h", "s1_id", "cid")])
    rows = _stacked(table.select([*FEATURES, "label"]), float)
    return rows[:, :-1], rows[:, -1]


def _stacked(batch: pa.RecordBatch | pa.Table, kind: type) -> np.ndarray:
    return np.nan_to_num(np.stack([c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy() for c in batch.columns], axis=1)).astype(kind)


Work = Callable[[np.ndarray, np.ndarray], bytes]


def _on_rows(work: Work, batches: Iterable[pa.RecordBatch], kind: type) -> bytes:
    """``work`` on the features and labels of all batches, which lie in a file of the task."""
    with models.local_file() as file:
        for batch in batches:
            file.write(_stacked(batch, kind).tobytes())
        file.flush()
        rows = np.zeros((0, len(FEATURES) + 1), kind)
        if file.tell():
            rows = np.asarray(np.memmap(file, kind, "r")).reshape(-1, rows.shape[1])
        return work(rows[:, :-1], rows[:, -1])


def on_all_pairs(pairs: DataFrame, *works: tuple[Work, type]) -> list[bytes]:
    """What each of ``works`` makes of the features and labels of all pairs, in the order of a hash of the pair.

    Each runs in one task of its own, all at once; its rows, of the float type given, go to a file there.  The driver gets
    the results only.
    """
    rows = _hashed(pairs).repartition(1).sortWithinPartitions("_h", "s1_id", "cid").select(*FEATURES, "label")

    def run(one: tuple[Work, type]) -> bytes:
        work, kind = one

        def task(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            yield pa.RecordBatch.from_pydict({"made": pa.array([_on_rows(work, batches, kind)], pa.binary())})

        made = rows.mapInArrow(task, "made binary").collect()  # one row, or none without partitions
        return bytes(made[0]["made"]) if made else _on_rows(work, [], kind)

    with ThreadPoolExecutor(max(1, len(works))) as beside:
        return list(beside.map(run, works))


def _screener(**settings) -> tuple[Work, type]:
    return lambda x, y: models.fit_trees(x, y, **settings).pack(), np.float64


def _specialist(**settings) -> tuple[Work, type]:
    def work(x: np.ndarray, y: np.ndarray) -> bytes:
        held = int(HELD_SHARE * len(x))
        return models.fit_network(x[held:], y[held:], x[:held], y[:held], **settings).pack()

    return work, np.float32


def fit_screener(pairs: DataFrame, **settings) -> Trees:
    """Gradient-boosted trees over the features of all pairs; ``settings`` as in ``models.fit_trees``."""
    return Trees.unpack(*on_all_pairs(pairs, _screener(**settings)))


def fit_specialist(pairs: DataFrame, **settings) -> Network:
    """The residual network; a tenth of the pairs decides when to stop.  ``settings`` as in ``models.fit_network``."""
    return Network.unpack(*on_all_pairs(pairs, _specialist(**settings)))


def _probabilities(screener: Trees, specialist: Network | None, low: float, high: float, columns: list[Column]) -> Column:
    """Struct (screener, specialist) of every row, in one Arrow exchange; the specialist only sees the band."""

    @F.arrow_udf("screener double, specialist double")
    def both(*values: pa.Array) -> pa.Array:
        x = np.nan_to_num(np.stack([v.to_numpy(zero_copy_only=False).astype(float) for v in values], axis=1))
        p = screener.probability(x)
        inside = (p >= low) & (p < high) if specialist is not None else np.zeros(len(p), bool)
        q = np.zeros(len(p))
        if inside.any():
            q[inside] = specialist.probability(x[inside])
        return pa.StructArray.from_arrays([pa.array(p), pa.array(q, mask=~inside)], ["screener", "specialist"])

    return both(*columns)


@dataclass(frozen=True)
class Cascade:
    """The screener decides outside the band; inside, the specialist has a share."""

    screener: Trees
    specialist: Network | None = None
    config: LinkConfig = LinkConfig()

    def score(self, pairs: DataFrame) -> DataFrame:
        """Adds prob, rounded."""
        low, high = self.config.band
        scored = pairs.withColumn("_p", _probabilities(self.screener, self.specialist, low, high, [F.col(f).cast("double") for f in FEATURES]))
        first, second = F.col("_p.screener"), F.col("_p.specialist")
        blended = cascade_blend(first, F.coalesce(second, first), low, high, self.config.screener_share)
        return scored.withColumn("prob", F.round(blended, self.config.probability_decimals)).drop("_p")

    def save(self, spark, folder: str) -> None:
        """One small Parquet table: model, blob."""
        rows = [("screener", bytearray(self.screener.pack()))] + ([("specialist", bytearray(self.specialist.pack()))] if self.specialist is not None else [])
        spark.createDataFrame(rows, "model string, blob binary").coalesce(1).write.mode("overwrite").parquet(folder)

    @staticmethod
    def load(spark, folder: str, with_specialist: bool = True, config: LinkConfig = LinkConfig()) -> Cascade:
        blobs = {r["model"]: bytes(r["blob"]) for r in spark.read.parquet(folder).collect()}  # two rows
        return Cascade(Trees.unpack(blobs["screener"]), Network.unpack(blobs["specialist"]) if with_specialist and "specialist" in blobs else None, config)


def fit_cascade(pairs: DataFrame, config: LinkConfig = LinkConfig()) -> Cascade:
    """Both models with their own settings, each in a task of its own over all pairs."""
    screener, specialist = on_all_pairs(pairs, _screener(), _specialist())
    return Cascade(Trees.unpack(screener), Network.unpack(specialist), config)


def feature_importance(screener: Trees, k: int = 10) -> list[tuple[str, float]]:
    """The k features of the largest gain, as shares of all."""
    return sorted(zip(FEATURES, map(float, screener.gains / max(screener.gains.sum(), 1e-12))), key=lambda x: (-x[1], x[0]))[:k]


def area_under_curve(model: Trees | Network, pairs: DataFrame) -> float:
    """Over all pairs."""
    return float(on_all_pairs(pairs, (lambda x, y: repr(models.area_under_curve(y, model.probability(x))).encode(), np.float64))[0])


def hard_negatives(scored: DataFrame, least: float = 0.35) -> DataFrame:
    """Non-matches that score high: s1_id, cid, texts of both sides, prob, label."""
    return scored.where((F.col("label") == 0) & (F.col("prob") >= least))


def random_search(train: DataFrame, val: DataFrame, s1: DataFrame, truth: DataFrame, space: dict[str, list] = SEARCH_SPACE, trials: int = 15, floors: tuple[float, ...] = NAME_FLOORS, seed: int = 42, **fixed) -> list[dict]:
    """Trials over random settings of ``fit_trees`` and name floors, best macro F0.5 first.

    Each trial is fitted in a task of its own over all of ``train``, and its thresholds are swept over all of ``val``; the
    caller keeps both persisted.  All trials and floors share one sweep, which returns the best threshold of each floor of
    a trial.
    """
    grid, rng = tuple(round(0.40 + 0.05 * i, 2) for i in range(11)), random.Random(seed)
    drawn = [{k: rng.choice(v) for k, v in space.items()} for _ in range(trials)]
    if not drawn or not floors:
        return []
    blobs = on_all_pairs(train, *[_screener(seed=seed, **(fixed | params)) for params in drawn])
    scored = [Cascade(Trees.unpack(blob)).score(val).select("s1_id", "cid", "name_token_set", "prob", F.lit(n).alias("trial")) for n, blob in enumerate(blobs)]
    each = union_sources(*scored).select("*", F.explode(F.array(*[F.lit(float(f)) for f in floors])).alias("name_sim_floor"))
    gated = each.withColumn("prob", name_floor_gate(F.col("prob"), F.col("name_token_set"), F.col("name_sim_floor")))
    groups = train.sparkSession.createDataFrame([(n, float(f)) for n in range(trials) for f in floors], "trial int, name_sim_floor double")
    best = threshold_sweep(s1, truth, gated, grid, groups).where("best").collect()  # one row for each trial and floor
    out = [{"trial": b["trial"], "params": drawn[b["trial"]], "name_sim_floor": b["name_sim_floor"], "best_thresh": b["threshold"], "macro_f05": b["macro_f05"]} for b in best]
    return sorted(out, key=lambda x: (-x["macro_f05"], x["trial"], x["name_sim_floor"]))
