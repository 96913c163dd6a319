"""Small Spark helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and about BATCH_BYTES: texts are long, and each Python worker holds a
    batch or two.  Plans read these settings when they run, so they stay set in the session."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a kernel that turns one batch into any number of batches."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from kernel(batch)
        relax(None)

    bound_batches(df.sparkSession)
    return df.mapInArrow(each, schema)


def smallest_hashes(ids: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` distinct values of the column _id with the smallest hashes.  About twice as many pass a bound on the
    hash, set by the number of values, so that what is sorted does not grow with the table."""
    h, n = F.xxhash64("_id"), ids.agg(F.approx_count_distinct("_id")).first()[0]
    share = (2 * rows + 1000) / max(n, 1)
    few = ids if share >= 1 else ids.where(h < int((share - 0.5) * 2**64))
    return few.select("_id").distinct().orderBy(h, "_id").limit(rows)


def one_each(df: DataFrame) -> DataFrame:
    """One row for each doc_id, the smallest of equal ids."""
    others = [c for c in df.columns if c != "doc_id"]
    return df.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("_one")).select("doc_id", "_one.*")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """All rows (doc_id, text, y) of at most ``rows`` labelled ids outside the held-out fold, chosen by a hash of the id.

    Rows whose id or label is null are left out; an id with several labels takes the largest.  The chosen ids are at
    most ``rows``, so that side is broadcast; the texts are read whole.  See one_each for rows that repeat an id.
    """
    usable = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (fold("_id", modulus) != held_out))
    chosen = usable.join(F.broadcast(smallest_hashes(usable, rows)), "_id").groupBy("_id").agg(F.max("_y").alias("_y"))
    return docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select(F.col("_doc").alias("doc_id"), F.col("_text").alias("text"), F.col("_y").alias("y"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, measured in one pass over that column."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def relax(out):
    """``out``, after memory that the allocators kept from finished work went back to the system: workers live on."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.  Where that is unset, a
    temporary folder if the whole of Spark is this one process (tests), else an error."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not (spark.conf.get("spark.master", "") or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    path = f"file://{tempfile.mkdtemp(prefix='kinforge-')}"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


ROWS_PER_PARTITION = 40_000


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """Merge partitions until each may hold ROWS_PER_PARTITION of at most ``rows`` rows, so that a small table's next
    shuffle does not write a file for every partition of the last one.  The number still grows with the rows."""
    return df.coalesce(max(1, -(-rows // ROWS_PER_PARTITION)))


def settle(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, int]:
    """materialize, with partitions for at most ``rows`` rows if that is known, and count."""
    done = materialize(df if rows is None else narrow(df, rows))
    n = done.count()
    return narrow(done, n), n
