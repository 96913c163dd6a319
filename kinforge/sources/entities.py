"""Entity, truth, score and dictionary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])


def delimiter_for(path: str) -> str:
    """Tab for .tsv, else comma."""
    return "\t" if path.lower().rstrip("/").endswith(".tsv") else ","


def _text_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; the header is the first line."""
    return spark.read.csv(path, sep=delimiter_for(path), header=True, inferSchema=False, quote='"', escape='"', encoding="UTF-8")


def _find(columns: list[str], *marks: str, default: int) -> str:
    for c in columns:
        if any(m in c.lower() for m in marks):
            return c
    return columns[min(default, len(columns) - 1)]


def read_entities(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Columns by what their headers say, or by place; a leading index column is skipped; missing text is ''.

    ``ids`` (entity_id) restricts the scan to those records.
    """
    raw = _text_table(spark, path)
    cols = raw.columns
    shift = 1 if len(cols) > 2 and cols[1].lower() == "entity_id" else 0
    rest = cols[shift:]
    found = [_find(rest, "entity_id", default=0), _find(rest, "name", default=1), _find(rest, "address", "addr", default=2), _find(rest, "country", default=3)]
    out = raw.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(f.name) for c, f in zip(found, ENTITY)])
    return out if ids is None else out.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")


def _line_order() -> F.Column:
    """Sorts rows of files as they stand there."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(s1_id, cids): the matched ids as an array without repeats, empty for a record without a match.

    Of several rows of a record the last in the file holds.
    """
    raw = _text_table(spark, path)
    cols = raw.columns
    shift = 1 if len(cols) > 2 and "source1" in cols[1].lower() else 0
    rows = raw.select(F.trim(F.col(f"`{cols[shift]}`")).alias("s1_id"), F.col(f"`{cols[shift + 1]}`").alias("matched_ids"), _line_order().alias("line"))
    last = rows.groupBy("s1_id").agg(F.max(F.struct("line", "matched_ids")).alias("r"))
    return explode_list(last.select("s1_id", F.col("r.matched_ids").alias("matched_ids")))


def split_ids(cell) -> F.Column:
    """Ids of a comma-joined cell, trimmed, without empty ones and repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def explode_list(lists: DataFrame) -> DataFrame:
    return lists.select("s1_id", split_ids(F.col("matched_ids")).alias("cids"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(s1_id, cid) of the records that have matches."""
    return truth.select("s1_id", F.explode("cids").alias("cid"))


def read_ids(spark: SparkSession, path: str, name: str = "entity_id", first: int | None = None) -> DataFrame:
    """One id a line; with ``first``, of the first lines alone."""
    ids = spark.read.text(path).select(F.trim("value").alias(name), _line_order().alias("line"))
    return (ids if first is None else ids.orderBy("line").limit(first)).where(F.col(name) != "").select(name)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    raw = _text_table(spark, path)
    a, b, p = raw.columns[:3]
    return raw.select(F.col(a).alias("s1_id"), F.col(b).alias("cid"), F.col(p).cast("double").alias("prob"))


def write_table(df: DataFrame, path: str) -> None:
    """Delimited text with a header, the delimiter by the path's ending."""
    df.write.mode("overwrite").csv(path, sep=delimiter_for(path), header=True, quote='"', escape='"', emptyValue="")


def write_scores(scores: DataFrame, path: str) -> None:
    """Probabilities printed to six decimals."""
    write_table(scores.select(F.col("s1_id").alias("source1_entity_id"), F.col("cid").alias("cand_entity_id"), F.format_string("%.6f", "prob").alias("prob")), path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    write_json(dictionary.select("word", "latin"), path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, latin); a path that does not exist is an empty dictionary."""
    schema = "word string, latin string"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def validate_submission(s1: DataFrame, matches: DataFrame, candidates: DataFrame) -> dict[str, int]:
    """Counts of what would be wrong: records without a row, rows beyond the records, matches outside the candidates."""
    ids = s1.select("s1_id")
    return {
        "missing": ids.join(matches, "s1_id", "left_anti").count(),
        "unknown": matches.select("s1_id").join(ids, "s1_id", "left_anti").count(),
        "repeated": matches.groupBy("s1_id").count().where("count > 1").count(),
        "outside": matches.select("s1_id", F.explode(split_ids(F.col("matched_ids"))).alias("cid")).join(candidates, ["s1_id", "cid"], "left_anti").count(),
    }
