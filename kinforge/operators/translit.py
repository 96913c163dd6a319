"""Learning and applying a word dictionary from Indic to Latin spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_brahmic, squeeze_spaces, transliterate_token


def aligned_words(pairs: DataFrame, latin: str, indic: str) -> DataFrame:
    """(word, latin): words at equal places of two texts of equally many words, the second side's in an Indic script."""
    split = lambda c: F.filter(F.split(squeeze_spaces(F.coalesce(c, F.lit(""))), " "), lambda t: t != "")
    both = pairs.select(split(F.col(latin)).alias("l"), split(F.col(indic)).alias("i")).where((F.size("l") == F.size("i")) & (F.size("l") > 0))
    zipped = both.select(F.explode(F.arrays_zip("i", "l")).alias("z")).select(F.col("z.i").alias("word"), F.col("z.l").alias("latin"))
    return zipped.where(has_brahmic(F.col("word")) & ~has_brahmic(F.col("latin"))).select("word", F.lower("latin").alias("latin"))


def learn_dictionary(votes: DataFrame) -> DataFrame:
    """(word, latin, n): the most frequent spelling of each word; ties go to the smaller spelling."""
    counted = votes.groupBy("word", "latin").agg(F.count("*").alias("n"))
    top = counted.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("m"), "latin")).alias("t"))
    return top.select("word", F.col("t.latin").alias("latin"), (-F.col("t.m")).alias("n"))


def dictionary_votes(truth: DataFrame, s1: DataFrame, candidates: DataFrame, country: str = "India") -> DataFrame:
    """Aligned words of names and addresses over the true pairs (s1_id, cand_id) of one country."""
    a = s1.where(F.col("country") == country).select(F.col("entity_id").alias("s1_id"), F.col("business_name").alias("s1_name"), F.col("business_address").alias("s1_addr"))
    b = candidates.select(F.col("entity_id").alias("cand_id"), F.col("business_name").alias("c_name"), F.col("business_address").alias("c_addr"))
    pairs = truth.join(a, "s1_id").join(b, "cand_id")
    return aligned_words(pairs, "s1_name", "c_name").unionByName(aligned_words(pairs, "s1_addr", "c_addr"))


def apply_dictionary(entities: DataFrame, dictionary: DataFrame, columns: tuple[str, ...] = ("business_name", "business_address")) -> DataFrame:
    """Rewrite the Indic words of ``columns``: by the dictionary, or by how they are spoken if it lacks them.

    Texts without a dictionary word or an Indic word keep their spacing; an empty dictionary changes nothing.  Only
    distinct words are looked up and spelled, and the dictionary is joined, whatever its size.
    """
    if dictionary.isEmpty():
        return entities
    out = entities
    for c in columns:
        keyed = out.withColumn("_row", F.xxhash64("entity_id", F.coalesce(F.col(c), F.lit(""))))
        words = keyed.select("_row", "entity_id", F.posexplode(F.split(squeeze_spaces(F.coalesce(c, F.lit(""))), " ")).alias("i", "word"))
        known = words.select("word").distinct().join(dictionary.select("word", "latin"), "word", "left")
        spelled = known.where(F.col("latin").isNull() & has_brahmic(F.col("word"))).select("word", transliterate_token(F.col("word")).alias("new"))
        new = known.where("latin is not null").select("word", F.col("latin").alias("new")).unionByName(spelled)
        changed = words.join(new, "word", "left").groupBy("_row", "entity_id").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("new", "word").alias("w")))).alias("w"), F.count("new").alias("n"))
        text = changed.where("n > 0").select("_row", "entity_id", F.array_join(F.transform("w", lambda x: x["w"]), " ").alias("_text"))
        out = keyed.join(text, ["_row", "entity_id"], "left").withColumn(c, F.coalesce("_text", c)).select(*entities.columns)
    return out
