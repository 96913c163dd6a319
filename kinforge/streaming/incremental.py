"""Linking reference records that arrive as a stream against a saved index.

An addition of this engine: records are independent of one another until owners are resolved, so a micro-batch is
linked like any table.  Owners are resolved over what has been accepted so far, by ``dedupe_matches`` on the output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import CandidateIndex
from ..plans.resolve import Scorer, link, surrogate_score
from ..sources.entities import ENTITY


def read_entity_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Entity records of the Parquet files that appear in a folder."""
    return spark.readStream.schema(ENTITY).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def link_stream(records: DataFrame, index: CandidateIndex, output: str, checkpoint: str, scorer: Scorer = surrogate_score, kernels: bool = True) -> StreamingQuery:
    """Write the scores and accepted pairs of every micro-batch under ``output``; a batch that is retried replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        got = link(batch, [], scorer, index.config, kernels=kernels, index=index)
        got.scores.write.mode("overwrite").parquet(f"{output}/scores/batch={number}")
        got.accepted.write.mode("overwrite").parquet(f"{output}/accepted/batch={number}")
        batch.unpersist()

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
