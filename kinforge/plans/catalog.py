"""Registered queries of the linkage engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions import kernels as kn
from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import decode as dc
from ..operators import evaluate as ev
from ..operators import index as ix
from ..operators import keys as ky
from ..operators import retrieve as rt
from ..operators import split as sp
from ..operators import training as tr
from ..operators import translit as tl
from ..operators.inmemory import retrieve_simple
from ..sources import entities as en
from ..sources.fixtures import view
from . import oracles as oq
from .oracles import sql
from .resolve import link, reference_records, surrogate_score, train_and_link

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The derived tables of one folder, planned when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, cap: int = 150, cut: bool = False):
        self.spark, self.dir, self.config = spark, sf_dir, LinkConfig(posting_cap=cap, cut=cut)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return view(self.spark, self.dir, name)

    @cached_property
    def s1_raw(self) -> DataFrame:
        return self.view("biz_s1")

    @cached_property
    def cand_raw(self) -> DataFrame:
        return ix.union_sources(self.view("biz_s2"), self.view("biz_s3"))

    @cached_property
    def s1(self) -> DataFrame:
        return reference_records(self.s1_raw, self.config)

    @cached_property
    def index(self) -> ix.CandidateIndex:
        return ix.build_index([self.cand_raw], self.config)

    @cached_property
    def everyone(self) -> DataFrame:
        return ix.normalize_entities(ix.union_sources(self.s1_raw, self.cand_raw))

    @cached_property
    def truth(self) -> DataFrame:
        return self.view("biz_truth")

    @cached_property
    def postings(self) -> DataFrame:
        """Before the cap."""
        return ky.blocking_keys(self.index.candidates, "cid", self.index.df, self.config)

    @cached_property
    def ranked(self) -> DataFrame:
        return rt.retrieve(self.s1, self.index, by_text=False)

    @cached_property
    def features(self) -> DataFrame:
        return sim.with_features(self.ranked, kernels=False)

    @cached_property
    def scores(self) -> DataFrame:
        return ix.kept(surrogate_score(self.features).select("s1_id", "cid", "rank", "country", "prob"), self.config)

    @cached_property
    def training(self) -> DataFrame:
        """Labelled pairs with all features and the part of the split; the models read them many times."""
        pairs = tr.training_pairs(self.ranked, self.truth, self.s1, self.index.candidates)
        return ix.kept(pairs.join(sp.split_entities(self.s1, "s1_id"), "s1_id"), self.config)

    @cached_property
    def tuning(self) -> tuple[DataFrame, DataFrame]:
        """The training part's labelled pairs, and all retrieved pairs of the validation part, both with all features.

        What was retrieved is kept as ids; features are made for the pairs that are used.
        """
        parts = sp.split_entities(self.s1, "s1_id")
        ids = ix.kept(self.ranked.select("s1_id", "cid", "rank").join(parts, "s1_id"), self.config)
        train, val = (rt.attach(ids.where(F.col("part") == part).drop("part"), self.s1, self.index.candidates) for part in ("train", "val"))
        truth = self.truth.join(parts.where("part = 'train'"), "s1_id", "left_semi")
        pairs = tr.training_pairs(train, truth, self.s1, self.index.candidates)
        return ix.kept(pairs, self.config), ix.kept(sim.with_features(val).select("s1_id", "cid", *sim.FEATURES), self.config)

    @cached_property
    def accepted(self) -> DataFrame:
        return dc.decode_all(self.s1, self.scores)

    @cached_property
    def matches(self) -> DataFrame:
        return dc.dedupe_matches(self.accepted, self.scores)

    @cached_property
    def indic(self) -> DataFrame:
        """India's reference names, and the same in Devanagari letters."""
        text = F.lower(F.regexp_replace("business_name", " Inc\\.$", ""))
        return self.s1_raw.where("country = 'India'").select(F.col("entity_id").alias("s1_id"), text.alias("latin"), F.translate(text, oq.LETTERS, oq.DEVANAGARI).alias("indic"))


def register(oracle: str | None = None, cap: int = 150, cut: bool = False):
    """Register ``build(tables)`` under its name; ``oracle`` is the DuckDB text, ``cap`` and ``cut`` are settings."""

    def wrap(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = build.__name__
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir, cap, cut))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return wrap


# --- scans, projections, scalar functions ---------------------------------------------------------------------------


@register(sql("SELECT entity_id, trim(business_name) AS business_name, trim(business_address) AS business_address, country FROM cands"))
def scan_entities(t):
    return t.cand_raw.select("entity_id", F.trim("business_name").alias("business_name"), F.trim("business_address").alias("business_address"), "country")


@register(sql("SELECT * FROM biz_s2 UNION ALL SELECT * FROM biz_s3"))
def union_sources(t):
    return t.cand_raw


@register(sql("SELECT s1_id, cid FROM biz_truth"))
def load_truth(t):
    lists = t.truth.groupBy("s1_id").agg(F.concat_ws(",", F.collect_list("cid")).alias("matched_ids"))
    return en.truth_pairs(en.explode_list(lists))


@register(sql("SELECT s.entity_id AS s1_id, coalesce(string_agg(t.cid, ',' ORDER BY t.cid), '') AS matched_ids FROM biz_s1 s LEFT JOIN biz_truth t ON s.entity_id = t.s1_id GROUP BY 1"))
def match_list_cells(t):
    return dc.match_lists(t.s1_raw.select(F.col("entity_id").alias("s1_id")), t.truth)


@register(sql("SELECT s1_id, cid FROM biz_truth"))
def explode_truth(t):
    cells = dc.match_lists(t.s1_raw.select(F.col("entity_id").alias("s1_id")), t.truth)
    return en.truth_pairs(en.explode_list(cells))


@register(sql("SELECT cid, name, addr, country, norm_name, norm_addr FROM nc WHERE cid IN ('S2-12', 'S3-8', 'S2-404')"))
def lookup_by_id(t):
    ids = t.spark.createDataFrame([("S2-12",), ("S3-8",), ("S2-404",), ("S9-0",)], "cid string")
    return ix.lookup(t.index, ids).select("cid", "name", "addr", "country", "norm_name", "norm_addr")


@register(sql("SELECT s.* FROM biz_s1 s WHERE s.entity_id IN (SELECT s1_id FROM biz_truth)"))
def filter_by_id_list(t):
    return sp.keep_ids(t.s1_raw, t.truth.select(F.col("s1_id").alias("entity_id")))


@register(sql("SELECT entity_id, norm_name, norm_addr, comp_name, country FROM norm"))
def normalize_entities(t):
    return t.everyone.select("entity_id", "norm_name", "norm_addr", "comp_name", "country")


@register(sql("SELECT entity_id, comp_name FROM norm"))
def compressed_name(t):
    return t.everyone.select("entity_id", tx.compressed_name(F.col("norm_name")).alias("comp_name"))


@register(sql(f"SELECT entity_id, {oq.clean('business_name')} AS cleaned, {oq.clean('business_address')} AS cleaned_addr FROM ents"))
def clean_basic(t):
    e = ix.union_sources(t.s1_raw, t.cand_raw)
    return e.select("entity_id", tx.clean_basic(F.col("business_name")).alias("cleaned"), tx.clean_basic(F.col("business_address")).alias("cleaned_addr"))


@register(sql("SELECT entity_id, norm_name FROM norm"))
def normalize_name(t):
    e = ix.union_sources(t.s1_raw, t.cand_raw)
    return e.select("entity_id", tx.normalize_name(F.col("business_name")).alias("norm_name"))


@register(sql("SELECT entity_id, norm_addr FROM norm"))
def normalize_address(t):
    e = ix.union_sources(t.s1_raw, t.cand_raw)
    return e.select("entity_id", tx.normalize_address(F.col("business_address")).alias("norm_addr"))


@register("SELECT doc_id, strip_accents(text) AS folded FROM documents")
def strip_accents(t):
    return t.raw("documents").select("doc_id", F.when(tx.needs_unicode(F.col("text")), tx.strip_accents(F.col("text"))).otherwise(tx.strip_latin_accents(F.col("text"))).alias("folded"))


@register(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}\p{Pc}]+'), lambda x: regexp_full_match(x, '\p{Nd}+')))), ',') AS numbers FROM documents")
def extract_numbers(t):
    return t.raw("documents").select("doc_id", F.array_join(tx.extract_numbers(F.lower("text")), ",").alias("numbers"))


@register(sql(f"SELECT entity_id, array_to_string({oq.distinctive('norm_name')}, ',') AS distinctive FROM norm"))
def distinctive_tokens(t):
    return t.everyone.select("entity_id", F.array_join(ky.distinctive_tokens(F.col("norm_name")), ",").alias("distinctive"))


@register(sql(f"SELECT entity_id, array_to_string({oq.anchors('norm_addr')}, ',') AS words FROM norm"))
def addr_token_candidates(t):
    return t.everyone.select("entity_id", F.array_join(F.array_sort(ky.address_anchors(F.col("norm_addr"))), ",").alias("words"))


@register(sql(f"SELECT entity_id, array_to_string(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END, '|') AS ngrams FROM (SELECT entity_id, {oq.words('norm_name')} AS w FROM norm)"))
def token_ngrams(t):
    return t.everyone.select("entity_id", F.array_join(tx.token_ngrams(tx.tokens(F.col("norm_name")), 2), "|").alias("ngrams"))


@register(sql("SELECT entity_id, array_to_string(list_sort(list_distinct(CASE WHEN length(x) = 0 THEN [] WHEN length(x) < 3 THEN [x] ELSE list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)) END)), '|') AS ngrams FROM (SELECT entity_id, replace(norm_name, ' ', '') AS x FROM norm)"))
def char_ngrams(t):
    return t.everyone.select("entity_id", F.array_join(F.array_sort(tx.char_ngrams(F.col("norm_name"), 3)), "|").alias("ngrams"))


@register(sql("SELECT t AS word, sk AS skeleton FROM bones"))
def phonetic_skeleton(t):
    words = t.everyone.select(F.explode(tx.tokens(F.col("norm_name"))).alias("word")).distinct()
    return words.select("word", tx.phonetic_skeleton(F.col("word")).alias("skeleton"))


@register(sql("SELECT s1_id, true AS indic, false AS latin FROM indic"))
def has_brahmic(t):
    return t.indic.select("s1_id", tx.has_brahmic(F.col("indic")).alias("indic"), tx.has_brahmic(F.col("latin")).alias("latin"))


@register()
def translit_token(t):
    words = t.indic.select(F.explode(F.split("indic", " ")).alias("word")).distinct()
    return words.select("word", tx.transliterate_token(F.col("word")).alias("spelled"), tx.phonetic_skeleton(F.col("word")).alias("skeleton"))


@register(sql("SELECT word, latin, n FROM dict"))
def learn_translit(t):
    return tl.learn_dictionary(tl.aligned_words(t.indic, "latin", "indic"))


@register(sql("SELECT s1_id AS entity_id, string_agg(d.latin, ' ' ORDER BY w.i) AS business_name FROM (SELECT s1_id, unnest(string_split(indic, ' ')) AS word, generate_subscripts(string_split(indic, ' '), 1) AS i FROM indic) w JOIN dict d USING (word) GROUP BY 1"))
def apply_translit(t):
    dictionary = tl.learn_dictionary(tl.aligned_words(t.indic, "latin", "indic"))
    named = t.indic.select(F.col("s1_id").alias("entity_id"), F.col("indic").alias("business_name"))
    return tl.apply_dictionary(named, dictionary, ("business_name",))


# --- index ------------------------------------------------------------------------------------------------------------


@register(sql("SELECT country, token, df FROM addr_df"))
def addr_df(t):
    return t.index.df


@register(sql("SELECT n.entity_id, w.token, w.df FROM norm n JOIN ranked_words w USING (entity_id) WHERE n.entity_id LIKE 'S1-%'"))
def rarity_lookup(t):
    words = t.s1.select(F.col("s1_id").alias("entity_id"), "country", F.explode(ky.address_anchors(F.col("norm_addr"))).alias("token"))
    return words.join(t.index.df, ["country", "token"], "left").select("entity_id", "token", F.coalesce("df", F.lit(0)).alias("df"))


@register(sql("SELECT entity_id, array_to_string(anchors, ',') AS anchors FROM rare"))
def rare_addr_tokens(t):
    return ky.rare_anchors(t.everyone, "entity_id", t.index.df).select("entity_id", F.array_join("anchors", ",").alias("anchors"))


@register(sql("SELECT entity_id, country, key, weight FROM wkeys"))
def blocking_keys(t):
    return ky.blocking_keys(t.everyone, "entity_id", t.index.df).select("entity_id", "country", "key", "weight")


@register(sql("SELECT country, key, n FROM hot"))
def hot_keys(t):
    return ix.hot_keys(t.postings, t.config.posting_cap)


@register(sql("SELECT country, key, n FROM hot", cap=50), cap=50)
def hot_keys_low_cap(t):
    return ix.hot_keys(t.postings, t.config.posting_cap)


@register(sql("SELECT cid, country, key FROM post"))
def cap_postings(t):
    return t.index.postings.select("cid", "country", "key")


@register(sql("SELECT cid, country, key FROM post", cap=50), cap=50)
def cap_postings_low_cap(t):
    return t.index.postings.select("cid", "country", "key")


@register(sql("SELECT *, round(n_postings / n_candidates, 6) AS keys_per_candidate FROM (SELECT (SELECT count(*) FROM nc) AS n_candidates, (SELECT count(*) FROM addr_df) AS n_tokens, (SELECT count(*) FROM post) AS n_postings)"))
def index_stats(t):
    return ix.index_stats(t.index)


# --- retrieval --------------------------------------------------------------------------------------------------------


@register(sql("SELECT s1_id, cid, weight FROM p_exact"))
def exact_name_join(t):
    return rt.equality_pass(t.s1, t.index.candidates, "norm_name", 20.0, 30)


@register(sql("SELECT s1_id, cid, weight FROM p_comp"))
def compressed_name_join(t):
    return rt.equality_pass(t.s1, t.index.candidates, "comp_name", 15.0, 30)


@register(sql("SELECT s1_id, cid, weight FROM p_key"))
def key_join(t):
    return rt.key_pass(rt.probe_keys(t.s1, t.index), t.index.postings)


@register(sql("SELECT s1_id, cid, weight FROM p_key", cap=50), cap=50)
def key_join_low_cap(t):
    return rt.key_pass(rt.probe_keys(t.s1, t.index), t.index.postings)


@register(sql("SELECT s1_id, cid, weight FROM pool_"))
def pool_scores(t):
    return rt.pool(t.s1, t.index)


@register(sql("SELECT s1_id, cid, weight, rank::INTEGER AS rank FROM top_", k=300))
def topk_by_weight(t):
    return rt.best(rt.pool(t.s1, t.index), ["s1_id"], [F.desc("weight"), "cid"], 300)


@register(sql("SELECT n.s1_id, coalesce(string_agg(t.cid, ',' ORDER BY t.rank), '') AS candidate_ids FROM n1 n LEFT JOIN top_ t USING (s1_id) GROUP BY 1"))
def candidate_lists(t):
    return rt.candidate_lists(t.s1, t.ranked)


@register(sql(f"SELECT s1_id, cid, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cid)::INTEGER AS rank, weight, round(score, 6) AS score FROM (SELECT s1_id, cid, weight, {oq.RERANK} AS score FROM att {oq.RERANK_SETS}) QUALIFY rank <= 35", k=300))
def rerank_topk(t):
    """Retrieval with the text rerank: needs the kernels."""
    return rt.retrieve(t.s1, t.index).select("s1_id", "cid", "rank", "weight", F.round("score", 6).alias("score"))


_simple = """simple AS (SELECT DISTINCT entity_id, country, kind, key FROM (
  SELECT entity_id, country, 'exact' AS kind, norm_name AS key FROM norm WHERE norm_name <> ''
  UNION ALL SELECT entity_id, country, 'compressed', replace(norm_name, ' ', '') FROM norm WHERE length(replace(norm_name, ' ', '')) >= 4
  UNION ALL SELECT entity_id, country, 'token', unnest(list_filter({words}, lambda t: length(t) >= 3 AND t NOT IN ({stop}))) FROM norm
  UNION ALL SELECT entity_id, country, 'anchor', n || '_' || w FROM (SELECT entity_id, country, n, unnest(al[1:2]) AS w FROM (SELECT entity_id, country, al, unnest(nums[1:3]) AS n FROM (SELECT entity_id, country, {addr} AS al, {nums} AS nums FROM norm)))
  UNION ALL SELECT entity_id, country, 'bigram', al[i] || '_' || al[i + 1] FROM (SELECT entity_id, country, al, unnest(range(1, least(len(al), 5))) AS i FROM (SELECT entity_id, country, {addr} AS al FROM norm))))""".format(words=oq.words("norm_name"), stop=oq.quoted(oq.NAME_STOPWORDS), addr=oq.address_list("norm_addr"), nums=oq.numbers("norm_addr"))
_simple_tail = """, capped AS (SELECT s.* FROM simple s WHERE entity_id NOT LIKE 'S1-%' AND (kind IN ('exact', 'compressed') OR (country, kind, key) NOT IN (SELECT (country, kind, key) FROM simple WHERE entity_id NOT LIKE 'S1-%' GROUP BY country, kind, key HAVING count(*) > 150)))
SELECT p.entity_id AS s1_id, c.entity_id AS cid, sum(CASE p.kind WHEN 'exact' THEN 15.0 WHEN 'compressed' THEN 12.0 WHEN 'token' THEN 2.0 WHEN 'anchor' THEN 4.0 ELSE 5.0 END::DOUBLE) AS weight
FROM simple p JOIN capped c ON p.country = c.country AND p.kind = c.kind AND p.key = c.key WHERE p.entity_id LIKE 'S1-%' GROUP BY 1, 2"""


def _simple_oracle() -> str:
    with_norm = sql("SELECT 1 FROM norm").removesuffix(" SELECT 1 FROM norm")
    body = f"{with_norm}, {_simple}{_simple_tail}"
    return f"SELECT s1_id, cid, weight, row_number() OVER (PARTITION BY s1_id ORDER BY weight DESC, cid)::INTEGER AS rank FROM ({body}) QUALIFY rank <= 35"


@register(_simple_oracle())
def blocking_inmemory(t):
    return retrieve_simple(t.s1, t.index.candidates)


# --- features and scores ----------------------------------------------------------------------------------------------


@register(sql("SELECT s1_id, cid, round(name_jaccard, 6) AS name_jaccard, round(addr_jaccard, 6) AS addr_jaccard FROM feat"))
def token_jaccard(t):
    return t.features.select("s1_id", "cid", F.round("name_jaccard", 6).alias("name_jaccard"), F.round("addr_jaccard", 6).alias("addr_jaccard"))


@register(sql("SELECT s1_id, cid, (sn <> '' AND snw[1] = coalesce(cnw[1], ''))::INTEGER::DOUBLE AS first_token_match FROM lists"))
def first_token_match(t):
    return t.features.select("s1_id", "cid", "first_token_match")


@register(sql("SELECT s1_id, cid, round(abs(length(sn) - length(cn)) / greatest(length(sn), length(cn), 1), 6) AS name_len_diff, round(abs(length(sa) - length(ca)) / greatest(length(sa), length(ca), 1), 6) AS addr_len_diff FROM att"))
def len_diff(t):
    return t.features.select("s1_id", "cid", F.round("name_len_diff", 6).alias("name_len_diff"), F.round("addr_len_diff", 6).alias("addr_len_diff"))


@register(sql("SELECT s1_id, cid, (cid LIKE 'S2-%')::INTEGER::DOUBLE AS is_source2 FROM att"))
def is_source2(t):
    return t.features.select("s1_id", "cid", "is_source2")


_exact = oq._num.format(none="1.0", both="(list_sort(a) = list_sort(b))::INTEGER::DOUBLE")
_overlap = oq._num.format(none="0.0", both="len(list_intersect(a, b))::DOUBLE")
_conflict = oq._num.format(none="0.0", both="(len(list_intersect(a, b)) = 0)::INTEGER::DOUBLE")


@register(sql(f"SELECT s1_id, cid, {_exact} AS num_exact_match, round(num_jaccard, 6) AS num_jaccard, {_overlap} AS num_overlap_count, {_conflict} AS num_conflict FROM feat"))
def number_features(t):
    return t.features.select("s1_id", "cid", "num_exact_match", F.round("num_jaccard", 6).alias("num_jaccard"), "num_overlap_count", "num_conflict")


@register(sql("SELECT s1_id, cid, (sn = cn)::INTEGER::DOUBLE AS name_ratio, (contains(sn, cn) OR contains(cn, sn))::INTEGER::DOUBLE AS name_partial_ratio, round(name_jaccard, 6) AS name_token_set, (sa = ca)::INTEGER::DOUBLE AS addr_ratio, (contains(sa, ca) OR contains(ca, sa))::INTEGER::DOUBLE AS addr_partial_ratio, round(addr_jaccard, 6) AS addr_token_sort FROM feat"))
def features_fallback(t):
    return t.features.select("s1_id", "cid", "name_ratio", "name_partial_ratio", F.round("name_token_set", 6).alias("name_token_set"), "addr_ratio", "addr_partial_ratio", F.round("addr_token_sort", 6).alias("addr_token_sort"))


@register(sql("SELECT s1_id, cid, CASE WHEN sn = cn THEN 1.0 WHEN sn = '' OR cn = '' THEN 0.0 ELSE round(jaro_winkler_similarity(sn, cn), 6) END AS name_jw FROM att"))
def name_jaro_winkler(t):
    return t.ranked.select("s1_id", "cid", F.round(kn.pair_function(kn.jaro_winkler)(F.col("s1_norm_name"), F.col("cand_norm_name"))[0], 6).alias("name_jw"))


def _kernel_sql(side: str, x: str, y: str) -> tuple[str, str]:
    """Columns and joins of the ratio family on one side."""
    r, p, s_, o, t = (f"{side}_{k}" for k in "rpsot")
    columns = f"round({r}.ratio, 6) AS {side}_ratio, round({p}.best, 6) AS {side}_partial_ratio, round({o}.ratio, 6) AS {side}_token_sort, round({t}.ratio, 6) AS {side}_token_set"
    joins = f"JOIN ratios {r} ON {oq.same_pair(r, x, y)} JOIN partials {p} ON {oq.same_pair(p, x, y)} JOIN spelled {s_} ON {s_}.x = {x} AND {s_}.y = {y} JOIN ratios {o} ON {oq.same_pair(o, f'{s_}.x_sorted', f'{s_}.y_sorted')} JOIN token_sets {t} ON {t}.x = {x} AND {t}.y = {y}"
    return columns, joins


_names, _addresses = _kernel_sql("name", "sn", "cn"), _kernel_sql("addr", "sa", "ca")
_jw = "CASE WHEN sn = cn THEN 1.0 WHEN sn = '' OR cn = '' THEN 0.0 ELSE round(jaro_winkler_similarity(sn, cn), 6) END"
_len = "round(abs(length({0}) - length({1})) / greatest(length({0}), length({1}), 1)::DOUBLE, 6)"
_all_features = (
    f"SELECT s1_id, cid, {_names[0]}, {_jw} AS name_jw, round(name_jaccard, 6) AS name_jaccard, round(k.ratio, 6) AS name_skeleton_ratio, (sn <> '' AND string_split(sn, ' ')[1] = string_split(cn, ' ')[1])::INTEGER::DOUBLE AS first_token_match, {_len.format('sn', 'cn')} AS name_len_diff, "
    f"{_addresses[0]}, round(addr_jaccard, 6) AS addr_jaccard, {_len.format('sa', 'ca')} AS addr_len_diff, (cid LIKE 'S2-%')::INTEGER::DOUBLE AS is_source2, num_exact_match, round(num_jaccard, 6) AS num_jaccard, num_overlap_count, num_conflict "
    f"FROM (SELECT f.* EXCLUDE (a, b), {_exact} AS num_exact_match, {_overlap} AS num_overlap_count, {_conflict} AS num_conflict, coalesce(p.bone, '') AS sb, coalesce(q.bone, '') AS cb FROM feat f LEFT JOIN skel p ON p.s1_or_c = sn LEFT JOIN skel q ON q.s1_or_c = cn) {_names[1]} {_addresses[1]} JOIN bone_sets k ON k.x = sb AND k.y = cb"
)


@register(sql(_all_features))
def pair_features(t):
    """All 20 features, kernels included."""
    made = sim.with_features(t.ranked)
    return made.select("s1_id", "cid", *[F.round(f, 6).alias(f) for f in sim.FEATURES])


# --- decisions --------------------------------------------------------------------------------------------------------


@register(sql("SELECT s1_id, cid, prob FROM scores WHERE prob >= 0.6"))
def decode_threshold(t):
    return dc.threshold_decode(t.scores, 0.6)


@register(sql("SELECT s1_id, cid, round(CASE WHEN prob >= 0.2 AND prob < 0.88 THEN 0.7 * prob + 0.3 * (1 - prob) ELSE prob END, 6) AS blended FROM scores"))
def cascade_blend(t):
    return t.scores.select("s1_id", "cid", F.round(dc.cascade_blend(F.col("prob"), 1 - F.col("prob")), 6).alias("blended"))


@register(sql("SELECT s1_id, cid, prob FROM scores QUALIFY max(prob) OVER (PARTITION BY s1_id) >= 0.7"))
def decode_floor(t):
    return dc.above_floor(t.scores).select("s1_id", "cid", "prob")


@register(sql("SELECT f.s1_id, f.cid, CASE WHEN f.name_jaccard < 0.25 THEN 0.0 ELSE s.prob END AS prob FROM feat f JOIN scores s USING (s1_id, cid)"))
def name_floor_gate(t):
    return surrogate_score(t.features).select("s1_id", "cid", dc.name_floor_gate(F.col("prob"), F.col("name_token_set"), 0.25).alias("prob"))


@register(sql("SELECT s1_id, k, n FROM pick"))
def expected_f05_decode(t):
    return dc.expected_f05_decode(t.scores)


@register(sql("SELECT s1_id, cid, prob FROM accepted"))
def decode_all(t):
    return t.accepted


@register(sql("SELECT cid, s1_id, prob FROM winners"))
def resolve_winners(t):
    return dc.resolve_winners(t.scores)


@register(sql("SELECT s1_id, cid FROM final"))
def dedupe_matches(t):
    return t.matches


@register(sql("SELECT (SELECT count(*) FROM accepted) AS before, (SELECT count(*) FROM final) AS after"))
def dedupe_counts(t):
    return t.accepted.agg(F.count("*").alias("before")).crossJoin(t.matches.agg(F.count("*").alias("after")))  # one row each


_lists = "SELECT n.s1_id, coalesce(string_agg(f.cid, ',' ORDER BY f.cid), '') AS matched_ids FROM n1 n LEFT JOIN final f USING (s1_id) GROUP BY 1"


@register(sql(_lists))
def resolve(t):
    """The flagship: the whole linkage in one plan, JVM only."""
    return link(t.s1_raw, [t.view("biz_s2"), t.view("biz_s3")], kernels=False).lists()


@register(sql(_lists, k=300, rerank=True))
def resolve_with_kernels(t):
    """The whole linkage with the text rerank and all features."""
    return link(t.s1_raw, [t.view("biz_s2"), t.view("biz_s3")]).lists()


# --- evaluation -------------------------------------------------------------------------------------------------------

_summary = """round(avg(f05), 6) AS macro_f05, count(*) AS total_entities, sum((n_true = 0)::BIGINT)::BIGINT AS singleton_count,
 round(coalesce(avg(CASE WHEN n_true = 0 THEN f05 END), 0.0), 6) AS singleton_accuracy, sum((n_true <> 0)::BIGINT)::BIGINT AS non_singleton_count, round(coalesce(avg(CASE WHEN n_true <> 0 THEN f05 END), 0.0), 6) AS non_singleton_f05"""


@register(sql("SELECT s1_id, n_true, n_pred, n_both, round(f05, 6) AS f05 FROM ef5"))
def entity_f05(t):
    return ev.entity_f05(t.s1, t.truth, t.matches).withColumn("f05", F.round("f05", 6))


@register(sql(f"SELECT {_summary} FROM ef5"))
def evaluate_f05(t):
    return ev.evaluate(t.s1, t.truth, t.matches)


@register(sql(f"SELECT country, {_summary} FROM ef5 GROUP BY country"))
def evaluate_by_country(t):
    return ev.evaluate(t.s1, t.truth, t.matches, by="country")


@register(sql(f"SELECT {_summary} FROM ef5", pred="ceiling"))
def recall_ceiling(t):
    """Macro F0.5 of a perfect matcher over the retrieved pairs."""
    return ev.evaluate(t.s1, t.truth, t.ranked.select("s1_id", "cid").join(t.truth, ["s1_id", "cid"], "left_semi"))


@register(sql("SELECT captured, total_pairs, avg_candidates, n_entities, round(captured / total_pairs, 6) AS recall FROM (SELECT (SELECT count(*) FROM biz_truth JOIN top_ USING (s1_id, cid)) AS captured, (SELECT count(*) FROM biz_truth WHERE s1_id IN (SELECT s1_id FROM top_)) AS total_pairs, (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM top_ GROUP BY s1_id)) AS avg_candidates, (SELECT count(DISTINCT s1_id) FROM top_) AS n_entities)"))
def blocking_recall(t):
    return ev.blocking_recall(t.truth, t.ranked)


_reasons = """SELECT t.s1_id, t.cid, s.country, CASE
 WHEN (t.s1_id, t.cid) IN (SELECT (s1_id, cid) FROM top_) THEN 'HIT' WHEN c.cid IS NULL THEN 'cand_not_in_index' WHEN c.country <> s.country THEN 'country_mismatch'
 WHEN (t.s1_id, t.cid) IN (SELECT (s1_id, cid) FROM pool_) THEN 'retrieved_but_ranked_out'
 WHEN EXISTS (SELECT 1 FROM probe p JOIN ckeys k ON p.country = k.country AND p.key = k.key WHERE p.s1_id = t.s1_id AND k.cid = t.cid) THEN 'shared_keys_all_capped' ELSE 'no_shared_key' END AS reason
 FROM biz_truth t JOIN n1 s USING (s1_id) LEFT JOIN nc c USING (cid)"""


@register(sql(_reasons))
def blocking_miss_reasons(t):
    return ev.miss_reasons(t.truth, t.s1, t.index, t.postings, t.ranked)


@register(sql(_reasons, cap=2, k=3), cap=2)
def blocking_miss_reasons_low_cap(t):
    """With a cap and a top that miss pairs, so that every reason occurs."""
    few = rt.best(rt.pool(t.s1, t.index), ["s1_id"], [F.desc("weight"), "cid"], 3)
    return ev.miss_reasons(t.truth, t.s1, t.index, t.postings, few)


@register(sql("SELECT m.name, s.n AS value FROM (SELECT 'p50' AS name, 0.5 AS share UNION ALL SELECT 'p90', 0.9 UNION ALL SELECT 'p99', 0.99 UNION ALL SELECT 'max', 1.0) m JOIN (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS total FROM (SELECT count(*) AS n FROM pool_ GROUP BY s1_id)) s ON s.i = least(floor(s.total * m.share::DOUBLE)::BIGINT, s.total - 1)"))
def pool_percentiles(t):
    sizes = rt.pool(t.s1, t.index).groupBy("s1_id").agg(F.count("*").alias("n"))
    return ev.nearest_rank(sizes, "n")


_sweep = """SELECT threshold, macro_f05, row_number() OVER (ORDER BY macro_f05 DESC, threshold) = 1 AS best FROM (SELECT threshold, round(avg(CASE WHEN n_true = 0 THEN (n_pred = 0)::INTEGER::DOUBLE
 WHEN n_pred = 0 OR n_both = 0 THEN 0.0 ELSE 1.25 * (n_both / n_pred) * (n_both / n_true) / (0.25 * (n_both / n_pred) + n_both / n_true) END), 6) AS macro_f05 FROM (
 SELECT g.threshold, s.s1_id, (SELECT count(*) FROM biz_truth b WHERE b.s1_id = s.s1_id) AS n_true, coalesce(p.n_pred, 0) AS n_pred, coalesce(p.n_both, 0) AS n_both
 FROM n1 s CROSS JOIN (SELECT unnest([0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9])::DOUBLE AS threshold) g
 LEFT JOIN (SELECT c.s1_id, g.threshold, count(*) AS n_pred, count(b.cid) AS n_both FROM scores c JOIN (SELECT unnest([0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9])::DOUBLE AS threshold) g ON c.prob >= g.threshold LEFT JOIN biz_truth b USING (s1_id, cid) GROUP BY 1, 2) p ON p.s1_id = s.s1_id AND p.threshold = g.threshold)
 GROUP BY threshold)"""


@register(sql(_sweep))
def threshold_sweep(t):
    return ev.threshold_sweep(t.s1, t.truth, t.scores, tuple(round(0.40 + 0.05 * i, 2) for i in range(11)))


@register(sql("SELECT s.country, count(*) AS n_entities, sum(coalesce(m.n, 0))::BIGINT AS n_matches, round(avg(coalesce(m.n, 0)), 6) AS matches_per_entity, round(avg((m.n IS NULL)::INTEGER::DOUBLE), 6) AS empty_rate FROM n1 s LEFT JOIN (SELECT s1_id, count(*) AS n FROM final GROUP BY 1) m USING (s1_id) GROUP BY 1"))
def match_volume_by_country(t):
    return ev.match_volume(t.s1, t.matches)


# --- training tables and splits ---------------------------------------------------------------------------------------


@register(sql("SELECT s1_id, cid, rank::INTEGER AS rank, ((s1_id, cid) IN (SELECT (s1_id, cid) FROM biz_truth))::INTEGER AS label FROM top_"))
def label_pairs(t):
    return tr.label_pairs(t.ranked.select("s1_id", "cid", "rank"), t.truth)


_missed = "SELECT t.s1_id, t.cid, c.norm_name AS cand_norm_name FROM biz_truth t JOIN nc c USING (cid) WHERE (t.s1_id, t.cid) NOT IN (SELECT (s1_id, cid) FROM top_)"


@register(sql(_missed))
def missed_positives(t):
    return tr.missed_positives(t.truth, t.ranked, t.s1, t.index.candidates).select("s1_id", "cid", "cand_norm_name")


@register(sql(_missed, k=1))
def missed_positives_top1(t):
    """What the best candidate of each record alone would miss."""
    few = rt.best(rt.pool(t.s1, t.index), ["s1_id"], [F.desc("weight"), "cid"], 1)
    return tr.missed_positives(t.truth, few, t.s1, t.index.candidates).select("s1_id", "cid", "cand_norm_name")


@register(sql("SELECT s1_id, cid, rank, label FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, label ORDER BY rank) AS p FROM (SELECT t.s1_id, t.cid, t.rank::INTEGER AS rank, (b.cid IS NOT NULL)::INTEGER AS label, coalesce(n.n, 0) AS n_true FROM top_ t LEFT JOIN biz_truth b USING (s1_id, cid) LEFT JOIN (SELECT s1_id, count(*) AS n FROM biz_truth GROUP BY 1) n USING (s1_id))) WHERE label = 1 OR p <= greatest(5 * n_true, 10)"))
def negative_sampling(t):
    counts = t.truth.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    labelled = tr.label_pairs(t.ranked.select("s1_id", "cid", "rank"), t.truth).join(counts, "s1_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))
    return sp.sample_negatives(labelled, 5).select("s1_id", "cid", "rank", "label")


@register(sql("SELECT s1_id, cid, prob, 0 AS label FROM scores WHERE prob >= 0.35 AND (s1_id, cid) NOT IN (SELECT (s1_id, cid) FROM biz_truth)"))
def hard_negatives(t):
    return tr.hard_negatives(tr.label_pairs(t.scores.select("s1_id", "cid", "prob"), t.truth)).select("s1_id", "cid", "prob", "label")


_bucket = "('0x' || substr(md5('42:' || entity_id), 1, 8))::BIGINT"


@register(sql(f"SELECT entity_id, CASE WHEN {_bucket} < 858993459 THEN 'val' ELSE 'train' END AS part FROM biz_s1"))
def split_entities(t):
    return sp.split_entities(t.s1_raw, "entity_id")


@register(sql(f"SELECT entity_id FROM biz_s1 WHERE {_bucket} >= 858993459 ORDER BY md5('42:' || entity_id), entity_id LIMIT 120"))
def train_ids(t):
    parts = sp.split_entities(t.s1_raw, "entity_id")
    return sp.train_ids(t.s1_raw.select("entity_id"), parts.where("part = 'val'"), "entity_id", 120)


@register(sql("SELECT s1_id FROM (SELECT DISTINCT s1_id FROM biz_truth) ORDER BY md5('7:' || s1_id), s1_id LIMIT 50"))
def positive_sample(t):
    return sp.positive_sample(t.truth, 50)


@register(cut=True)
def screener_scores(t):
    """Gradient-boosted screener: fitted on the training split's pairs, applied to the validation split's."""
    pairs = t.training
    model = tr.fit_screener(pairs.where("part = 'train'"))
    return tr.Cascade(model).score(pairs.where("part = 'val'")).select("s1_id", "cid", "label", "prob")


@register(cut=True)
def cascade_scores(t):
    """Screener and specialist, blended inside the band."""
    pairs = t.training
    cascade = tr.fit_cascade(pairs.where("part = 'train'"))
    return cascade.score(pairs.where("part = 'val'")).select("s1_id", "cid", "label", "prob")


@register()
def resolve_cascade(t):
    """The whole linkage with the text rerank, all features and both models, which learn from the training split."""
    return train_and_link(t.s1_raw, [t.view("biz_s2"), t.view("biz_s3")], t.truth)[0].lists()


@register()
def cascade_f05(t):
    """Macro F0.5 of the whole linkage, on the records that the models did not learn from."""
    linkage = train_and_link(t.s1_raw, [t.view("biz_s2"), t.view("biz_s3")], t.truth)[0]
    held = sp.split_entities(linkage.s1, "s1_id").where("part = 'val'").select("s1_id")
    return ev.evaluate(held, t.truth.join(held, "s1_id", "left_semi"), linkage.matches.join(held, "s1_id", "left_semi"))


@register(cut=True)
def tune_screener(t):
    """Random search over the screener's settings and name floors; three trials, swept over all that was retrieved."""
    (train, val), held = t.tuning, sp.split_entities(t.s1, "s1_id").where("part = 'val'").select("s1_id")
    truth = t.truth.join(held, "s1_id", "left_semi")
    found = tr.random_search(train, val, held, truth, trials=3)
    rows = [(f["trial"], f["name_sim_floor"], f["best_thresh"], f["macro_f05"], *[f["params"][k] for k in tr.SEARCH_SPACE]) for f in found]
    return t.spark.createDataFrame(rows, "trial int, name_sim_floor double, best_thresh double, macro_f05 double, leaves int, rate double, depth int, features double, rows double, least int")
