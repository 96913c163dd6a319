"""Blocking keys: order-invariant anchors that records of one organisation share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ADDRESS_STOPWORDS, NAME_STOPWORDS, SKELETON_STOPWORDS, LinkConfig
from ..functions.text import extract_numbers, phonetic_skeleton, tokens


def key_hash(country: Column, key: Column) -> Column:
    """A signed 64-bit number for a key of a country; not for decisions, as two keys can share one."""
    return F.xxhash64(F.concat_ws("|", country, key))


def distinctive_tokens(norm_name: Column, limit: int = 3) -> Column:
    """The first words of four letters or more that are no stopwords; repeats stay."""
    return F.slice(F.filter(tokens(norm_name), lambda t: (F.length(t) >= 4) & ~t.isin(NAME_STOPWORDS)), 1, limit)


def address_anchors(norm_addr: Column) -> Column:
    """Distinct words of three letters or more that are neither digits nor stopwords."""
    return F.array_distinct(F.filter(tokens(norm_addr), lambda t: (F.length(t) >= 3) & ~t.rlike(r"^[\p{Nd}]+$") & ~t.isin(ADDRESS_STOPWORDS)))


def skeleton_tokens(norm_name: Column, limit: int = 2) -> Column:
    bones = F.transform(F.filter(tokens(norm_name), lambda t: F.length(t) >= 3), phonetic_skeleton)
    return F.slice(F.filter(bones, lambda s: (F.length(s) >= 3) & ~s.isin(SKELETON_STOPWORDS)), 1, limit)


def document_frequency(candidates: DataFrame) -> DataFrame:
    """(country, token, df): candidates of the country whose address holds the token."""
    return candidates.select("country", F.explode(address_anchors(F.col("norm_addr"))).alias("token")).groupBy("country", "token").agg(F.count("*").alias("df"))


def rare_anchors(records: DataFrame, id_col: str, df: DataFrame, limit: int = 2) -> DataFrame:
    """(id, anchors): each record's rarest address words by (df, word); a word without df is rarest.

    The join is on (country, token), whose fan-out is one row; the words of a record are gathered again by a
    bounded aggregate.
    """
    words = records.select(id_col, "country", F.explode(address_anchors(F.col("norm_addr"))).alias("token"))
    ranked = words.join(df, ["country", "token"], "left").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))).alias("w"))
    return ranked.select(id_col, F.transform(F.slice("w", 1, limit), lambda x: x["token"]).alias("anchors"))


def _pairs(words: Column, prefix: str) -> Column:
    """prefix_a_b for every two of a sorted list (three at most)."""
    two = lambda i, j: F.concat_ws("_", F.lit(prefix), F.get(words, i), F.get(words, j))
    every = F.array(*[F.when(F.size(words) > j, two(i, j)) for i in range(3) for j in range(i + 1, 3)])
    return F.filter(every, lambda k: k.isNotNull())


def key_array(norm_name: Column, norm_addr: Column, country: Column, anchors: Column, config: LinkConfig = LinkConfig()) -> Column:
    """All keys of a record as (kind, key) structs, given its rarest address words."""
    make = lambda kind: (lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    names, numbers = distinctive_tokens(norm_name), extract_numbers(norm_addr)
    anchors = F.coalesce(anchors, F.array().cast("array<string>"))
    bones = F.array_sort(skeleton_tokens(norm_name))
    numbered = F.flatten(F.transform(F.slice(numbers, 1, 3), lambda n: F.transform(F.slice(anchors, 1, 2), lambda a: F.concat(F.lit("num_"), n, F.lit("_"), a))))
    none = F.array().cast("array<string>")
    skeleton = F.when(country.isin(list(config.skeleton_countries)) & (F.size(bones) > 0), F.array(F.concat(F.lit("sk_"), F.array_join(bones, "_")))).otherwise(none)
    parts = [
        F.transform(names, lambda t: make("tok")(F.concat(F.lit("tok_"), t))),
        F.transform(_pairs(F.array_sort(names), "tp"), make("tp")),
        F.transform(numbered, make("num")),
        F.transform(F.filter(numbers, lambda n: F.length(n) >= 4), lambda n: make("zip")(F.concat(F.lit("zip_"), n))),
        F.transform(_pairs(F.array_sort(F.slice(anchors, 1, config.address_pairs)), "bg"), make("bg")),
        F.transform(skeleton, make("sk")),
    ]
    keys = F.concat(*parts)
    return keys if config.keep_duplicate_keys else F.array_distinct(keys)


def blocking_keys(records: DataFrame, id_col: str, df: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """(id, country, key, weight) of every record; both sides of a linkage use the same ``df``."""
    with_anchors = records.select(id_col, "country", "norm_name", "norm_addr").join(rare_anchors(records, id_col, df, max(2, config.address_pairs)), id_col, "left")
    keys = key_array(F.col("norm_name"), F.col("norm_addr"), F.col("country"), F.col("anchors"), config)
    weights = F.create_map(*[F.lit(x) for pair in config.key_weights.items() for x in pair])
    return with_anchors.select(id_col, "country", F.explode(keys).alias("k")).select(id_col, "country", F.col("k.key").alias("key"), F.coalesce(F.try_element_at(weights, F.col("k.kind")), F.lit(2.0)).alias("weight"))
