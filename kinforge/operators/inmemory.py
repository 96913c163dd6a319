"""The plainer retrieval variant: exact, compressed, token, number-address and consecutive-word passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ADDRESS_STOPWORDS, NAME_STOPWORDS
from ..functions.text import extract_numbers, tokens
from .index import cap_postings
from .retrieve import best

WEIGHTS = {"exact": 15.0, "compressed": 12.0, "token": 2.0, "anchor": 4.0, "bigram": 5.0}


def _address_words(norm_addr: Column) -> Column:
    return F.filter(tokens(norm_addr), lambda t: (F.length(t) >= 3) & ~t.rlike(r"^[\p{Nd}]+$") & ~t.isin(ADDRESS_STOPWORDS))


def simple_keys(records: DataFrame, id_col: str) -> DataFrame:
    """(id, country, kind, key), repeated words once."""
    name, solid = F.col("norm_name"), F.replace("norm_name", F.lit(" "), F.lit(""))
    words, numbers = _address_words(F.col("norm_addr")), F.slice(extract_numbers(F.col("norm_addr")), 1, 3)
    some = lambda kind, keys: F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    none = F.array().cast("array<string>")
    follow = F.transform(F.sequence(F.lit(1), F.least(F.size(words) - 1, F.lit(4))), lambda i: F.concat_ws("_", F.element_at(words, i), F.element_at(words, i + 1)))
    keys = F.concat(
        some("exact", F.when(name != "", F.array(name)).otherwise(none)),
        some("compressed", F.when(F.length(solid) >= 4, F.array(solid)).otherwise(none)),
        some("token", F.filter(tokens(name), lambda t: (F.length(t) >= 3) & ~t.isin(NAME_STOPWORDS))),
        some("anchor", F.flatten(F.transform(numbers, lambda n: F.transform(F.slice(words, 1, 2), lambda w: F.concat_ws("_", n, w))))),
        some("bigram", F.when(F.size(words) >= 2, follow).otherwise(none)),
    )
    return records.select(id_col, "country", F.explode(keys).alias("k")).select(id_col, "country", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"))


def retrieve_simple(s1: DataFrame, candidates: DataFrame, cap: int = 150, k: int = 35) -> DataFrame:
    """(s1_id, cid, weight, rank).  Capped kinds drop a key above the cap as a whole; full names are not capped."""
    held = simple_keys(candidates, "cid").withColumn("key", F.concat_ws(":", "kind", "key"))
    full = F.col("kind").isin("exact", "compressed")
    postings = held.where(full).unionByName(cap_postings(held.where(~full), cap).select(*held.columns))
    probe = simple_keys(s1, "s1_id").withColumn("key", F.concat_ws(":", "kind", "key"))
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    scored = probe.join(postings.drop("kind"), ["country", "key"]).groupBy("s1_id", "cid").agg(F.sum(weights[F.col("kind")]).alias("weight"))
    return best(scored, ["s1_id"], [F.desc("weight"), "cid"], k)
