"""Entity tables derived from the benchmark tables ``part`` and ``documents``, as SQL that Spark and DuckDB share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = """base AS (
  SELECT p_partkey AS k,
    translate(substr(md5(cast(p_partkey AS string)),1,7),'0123456789','ghijklmnop') AS w1,
    translate(substr(md5(cast(p_partkey AS string)),9,6),'0123456789','qrstuvwxyz') AS w2,
    p_name, p_size,
    CASE WHEN p_partkey % 20 < 11 THEN 'US' WHEN p_partkey % 20 < 17 THEN 'India' ELSE 'France' END AS country
  FROM part)"""

S1 = """biz_s1 AS (
  SELECT 'S1-' || cast(k AS string) AS entity_id, w1 || ' ' || p_name || ' Inc.' AS business_name,
    cast(p_size AS string) || ' ' || w2 || ' St, ' || cast(10000 + k % 977 AS string) AS business_address, country
  FROM base WHERE k % 2 = 0)"""

S2 = """biz_s2 AS (
  SELECT 'S2-' || cast(k AS string) AS entity_id, upper(w1 || ' ' || p_name) || ' LLC' AS business_name,
    cast(10000 + k % 977 AS string) || ', ' || w2 || ' street #' || cast(p_size AS string) AS business_address, country
  FROM base WHERE k % 5 <> 0)"""

S3 = """biz_s3 AS (
  SELECT 'S3-' || cast(k AS string) AS entity_id,
    CASE WHEN k % 3 = 0 THEN replace(p_name, ' ', '') ELSE p_name END || ' ' || w1 AS business_name,
    cast(p_size + CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END AS string) || ' ' || w2 || ' Ave' AS business_address, country
  FROM base WHERE k % 7 < 4 AND k % 5 <> 0)"""

TRUTH = """biz_truth AS (
  SELECT s1.entity_id AS s1_id, c.entity_id AS cid
  FROM biz_s1 s1 JOIN (SELECT * FROM biz_s2 UNION ALL SELECT * FROM biz_s3) c
    ON substr(s1.entity_id,4) = substr(c.entity_id,4))"""

VIEWS = {"biz_s1": (S1,), "biz_s2": (S2,), "biz_s3": (S3,), "biz_truth": (S1, S2, S3, TRUTH)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ``VIEWS`` over the ``part`` table of a folder.

    Each text becomes a DataFrame of its own instead of a WITH clause: a plan that joins two with such clauses numbers
    them anew, and then no longer finds the persisted tables below them.
    """
    made = {"part": spark.read.parquet(f"{sf_dir}/part.parquet")}
    for text in (BASE, *VIEWS[name]):
        own, body = re.fullmatch(r"(\w+) AS \((.*)\)", text, re.DOTALL).groups()
        used = {t: df for t, df in made.items() if re.search(rf"\bFROM {t}\b", body)}
        made[own] = spark.sql(re.sub(rf"\bFROM ({'|'.join(used)})\b", r"FROM {\1}", body), **used)
    return made[name]
