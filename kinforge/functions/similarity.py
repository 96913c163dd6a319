"""Pair features over columns s1_* and cand_* (name, addr raw; norm_name, norm_addr normalized)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import address_kernels, name_kernels, set_kernel
from .text import extract_numbers, phonetic_skeleton, tokens

#: The order is a contract: models read the features as a vector.
FEATURES = (
    "name_ratio", "name_partial_ratio", "name_token_sort", "name_token_set", "name_jw",
    "name_jaccard", "name_skeleton_ratio", "first_token_match", "name_len_diff",
    "addr_ratio", "addr_partial_ratio", "addr_token_sort", "addr_token_set", "addr_jaccard", "addr_len_diff",
    "is_source2", "num_exact_match", "num_jaccard", "num_overlap_count", "num_conflict",
)


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token lists as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def length_difference(a: Column, b: Column) -> Column:
    return F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def first_token_match(a: Column, b: Column) -> Column:
    head = lambda x: F.element_at(F.split(x, " "), 1)
    return _flag((a != "") & (head(a) == head(b)))


def number_features(a: Column, b: Column) -> dict[str, Column]:
    """Of two lists of numbers: both empty agree, one empty says nothing."""
    neither, either = (F.size(a) == 0) & (F.size(b) == 0), (F.size(a) == 0) | (F.size(b) == 0)
    shared = F.size(F.array_intersect(a, b))
    same = (shared == F.size(F.array_union(a, b))).cast("double")
    case = lambda none, one, both: F.when(neither, F.lit(none)).when(either, F.lit(one)).otherwise(both)
    return {
        "num_exact_match": case(1.0, 0.0, same),
        "num_jaccard": case(1.0, 0.0, shared / F.size(F.array_union(a, b))),
        "num_overlap_count": case(0.0, 0.0, shared.cast("double")),
        "num_conflict": case(0.0, 0.0, (shared == 0).cast("double")),
    }


def name_skeleton(norm_name: Column) -> Column:
    """Skeletons of the words of three letters or more, joined."""
    return F.array_join(F.transform(F.filter(tokens(norm_name), lambda t: F.length(t) >= 3), phonetic_skeleton), " ")


def native_features() -> dict[str, Column]:
    """The features that need no kernel; number features read the raw addresses."""
    name, other = F.col("s1_norm_name"), F.col("cand_norm_name")
    addr, other_addr = F.col("s1_norm_addr"), F.col("cand_norm_addr")
    return {
        "name_jaccard": jaccard(tokens(name), tokens(other)),
        "addr_jaccard": jaccard(tokens(addr), tokens(other_addr)),
        "first_token_match": first_token_match(name, other),
        "name_len_diff": length_difference(name, other),
        "addr_len_diff": length_difference(addr, other_addr),
        "is_source2": _flag(F.col("cid").startswith("S2-")),
        **number_features(extract_numbers(F.col("s1_addr")), extract_numbers(F.col("cand_addr"))),
    }


def fallback_features() -> dict[str, Column]:
    """All features with equality, containment and Jaccard in place of the kernels; runs in the JVM alone."""
    own = native_features()
    out = dict(own)
    for side in ("name", "addr"):
        a, b = F.col(f"s1_norm_{side}"), F.col(f"cand_norm_{side}")
        out |= {f"{side}_ratio": _flag(a == b), f"{side}_partial_ratio": _flag(a.contains(b) | b.contains(a)), f"{side}_token_sort": own[f"{side}_jaccard"], f"{side}_token_set": own[f"{side}_jaccard"]}
    out["name_jw"] = out["name_ratio"]
    out["name_skeleton_ratio"] = _flag(name_skeleton(F.col("s1_norm_name")) == name_skeleton(F.col("cand_norm_name")))
    return out


def with_features(pairs: DataFrame, kernels: bool = True) -> DataFrame:
    """Add the 20 features to pairs.  The kernels see each side's strings once, in one Arrow exchange."""
    if not kernels:
        made = fallback_features()
        return pairs.select("*", *[made[f].alias(f) for f in FEATURES])
    names = name_kernels(F.col("s1_norm_name"), F.col("cand_norm_name"))
    addresses = address_kernels(F.col("s1_norm_addr"), F.col("cand_norm_addr"))
    skeletons = set_kernel(name_skeleton(F.col("s1_norm_name")), name_skeleton(F.col("cand_norm_name")))
    scored = pairs.withColumns({"_n": names, "_a": addresses, "_s": skeletons})
    kinds = ("ratio", "partial_ratio", "token_sort", "token_set", "jw")
    made = native_features() | {f"name_{k}": F.col("_n")[i] for i, k in enumerate(kinds)} | {f"addr_{k}": F.col("_a")[i] for i, k in enumerate(kinds[:4])} | {"name_skeleton_ratio": F.col("_s")[0]}
    return scored.select(*pairs.columns, *[made[f].alias(f) for f in FEATURES])
