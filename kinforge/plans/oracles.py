"""DuckDB equivalents of the registered queries, put together from named common table expressions.

They restate each operator's meaning over the driver's tables (ASCII data, so accents need no folding).
"""

from __future__ import annotations

import re
import string

from ..config import ADDRESS_STOPWORDS, KEY_WEIGHTS, NAME_STOPWORDS, SKELETON_STOPWORDS, STREET_WORDS
from ..functions.text import LATIN_REWRITES
from ..sources.fixtures import BASE, S1, S2, S3, TRUTH

LEGAL = "pvt ltd pvtltd private limited privatelimited llp inc incorporated corp corporation llc co company sarl sasu sas sa eurl eirl sci snc scop gie cie".split()
LETTERS, DEVANAGARI = string.ascii_lowercase, "अबकदएफगहइजखलमनओपठरसतउवऔषयझ"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def clean(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), ',/\\|_-()[]{{}}.:;#\"''`', '                   '), '\\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def norm_name(x: str) -> str:
    return f"array_to_string(list_filter(string_split({clean(x)}, ' '), lambda t: t <> '' AND t NOT IN ({quoted(LEGAL)})), ' ')"


def norm_addr(x: str) -> str:
    case = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in STREET_WORDS.items())
    return f"array_to_string(list_transform(string_split({clean(x)}, ' '), lambda t: CASE t {case} ELSE t END), ' ')"


def comp_name(x: str) -> str:
    return f"CASE WHEN contains({x}, ' ') THEN replace({x}, ' ', '') ELSE '' END"


def distinctive(x: str) -> str:
    return f"list_filter({words(x)}, lambda t: length(t) >= 4 AND t NOT IN ({quoted(NAME_STOPWORDS)}))[1:3]"


def address_list(x: str) -> str:
    return f"list_filter({words(x)}, lambda t: length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ({quoted(ADDRESS_STOPWORDS)}))"


def anchors(x: str) -> str:
    return f"list_sort(list_distinct({address_list(x)}))"


def numbers(x: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({x}, '\\b\\d+\\b')))"


def jaccard(a: str, b: str) -> str:
    """Of two lists of distinct or repeated words, as sets."""
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({a}), list_distinct({b}))) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END"


def squeeze(x: str) -> str:
    for c in LETTERS + string.digits:
        x = f"regexp_replace({x}, '{c}{{2,}}', '{c}', 'g')"
    return x


def rewritten(x: str) -> str:
    x = f"lower({x})"
    for a, b in LATIN_REWRITES:
        x = f"replace({x}, '{a}', '{b}')"
    return f"replace(replace(replace({x}, 'ce', 'se'), 'ci', 'si'), 'c', 'k')"


def skeleton_of(table: str, column: str) -> str:
    """SELECT of (t, sk) for the distinct words of a column of lists."""
    bones = "CASE WHEN e[1] IN ('a','e','i','o','u') THEN e[1] ELSE '' END || translate(e, 'aeiou', '')"
    return f"SELECT t, {squeeze('b')} AS sk FROM (SELECT t, {bones} AS b FROM (SELECT t, {rewritten('t')} AS e FROM (SELECT DISTINCT unnest({column}) AS t FROM {table})))"


def matches_of(pairs: str) -> str:
    """Per distinct pair of strings a, b (the shorter first, at most 125 letters): full, and per letter of b the bits of a's equal letters."""
    bits = "list_sum(list_transform(range(length(a)), lambda i: CASE WHEN a[i + 1] = c THEN 1::HUGEINT << i::HUGEINT ELSE 0::HUGEINT END))"
    ordered = f"SELECT DISTINCT CASE WHEN length(x) <= length(y) THEN x ELSE y END AS a, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS b FROM ({pairs})"
    return f"SELECT a, b, (1::HUGEINT << length(a)::HUGEINT) - 1 AS filled, list_transform(string_split(b, ''), lambda c: coalesce({bits}, 0::HUGEINT)) AS hits FROM ({ordered})"


def common(hits: str) -> str:
    """Length of the longest common subsequence of a and the letters behind ``hits``, one bit for each letter of a."""
    return f"(length(a) - bit_count(list_reduce(list_prepend(filled, {hits}), lambda r, w: ((r + (r & w)) | (r - (r & w))) & filled)))"


def ratio_of(pairs: str) -> str:
    return f"SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 2 * {common('hits')} / (length(a) + length(b))::DOUBLE END AS ratio FROM ({matches_of(pairs)})"


def partial_of(pairs: str) -> str:
    """Over every window of the longer string, those cut off at both ends included."""
    window = "list_transform(range(1 - length(a), length(b)), lambda s: [greatest(s, 0) + 1, least(s + length(a), length(b))])"
    value = f"2 * {common('hits[p[1]:p[2]]')} / (length(a) + p[2] - p[1] + 1)::DOUBLE"
    return f"SELECT a, b, CASE WHEN a = '' THEN (b = '')::INTEGER::DOUBLE WHEN contains(b, a) THEN 1.0 ELSE list_max(list_transform({window}, lambda p: {value})) END AS best FROM ({matches_of(pairs)})"


def same_pair(p: str, x: str, y: str) -> str:
    return f"{p}.a = CASE WHEN length({x}) <= length({y}) THEN {x} ELSE {y} END AND {p}.b = CASE WHEN length({x}) <= length({y}) THEN {y} ELSE {x} END"


_weight = " ".join(f"WHEN '{k}' THEN {w}" for k, w in KEY_WEIGHTS.items())
_num = (
    "CASE WHEN len(a) = 0 AND len(b) = 0 THEN {none} WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE {both} END"
)

RERANK = f"55 * tn.ratio + 35 * ta.ratio + CASE WHEN len(list_intersect({numbers('sa')}, {numbers('ca')})) > 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END + 0.01::DOUBLE * weight"
RERANK_SETS = "JOIN token_sets tn ON tn.x = sn AND tn.y = cn JOIN token_sets ta ON ta.x = sa AND ta.y = ca"


def _spelled(name: str, pairs: str) -> str:
    """Shared words and both sides' own ones after them, as strings; sorted words."""
    lists_ = f"SELECT x, y, {words('x')} AS xs, {words('y')} AS ys FROM {pairs}"
    sets = f"SELECT *, list_sort(list_distinct(xs)) AS xd, list_sort(list_distinct(ys)) AS yd FROM ({lists_})"
    parts = f"SELECT *, list_filter(xd, lambda t: list_contains(yd, t)) AS core, list_filter(xd, lambda t: NOT list_contains(yd, t)) AS l, list_filter(yd, lambda t: NOT list_contains(xd, t)) AS r FROM ({sets})"
    text = lambda x: f"array_to_string({x}, ' ')"
    return f"{name} AS (SELECT x, y, len(xd) = 0 OR len(yd) = 0 AS blank, len(core) > 0 AND (len(l) = 0 OR len(r) = 0) AS inside, {text('core')} AS core, {text('list_concat(core, l)')} AS one, {text('list_concat(core, r)')} AS two, {text('list_sort(xs)')} AS x_sorted, {text('list_sort(ys)')} AS y_sorted FROM ({parts}))"


def _token_sets(name: str, table: str) -> str:
    """The shared words are a head of both strings, so against these all of them are common."""
    head = lambda x: f"CASE WHEN core = '' THEN 0.0 ELSE 2 * length(core) / (length(core) + length({x}))::DOUBLE END"
    pairs = f"SELECT one AS x, two AS y FROM {table} WHERE NOT blank AND NOT inside"
    return f"{name} AS (SELECT x, y, CASE WHEN blank THEN 0.0::DOUBLE WHEN inside THEN 1.0 ELSE greatest(q.ratio, {head('one')}, {head('two')}) END AS ratio FROM {table} LEFT JOIN ({ratio_of(pairs)}) q ON {same_pair('q', 'one', 'two')})"


CTE: dict[str, str] = {
    "base": BASE, "biz_s1": S1, "biz_s2": S2, "biz_s3": S3, "biz_truth": TRUTH,
    "ents": "ents AS (SELECT * FROM biz_s1 UNION ALL SELECT * FROM biz_s2 UNION ALL SELECT * FROM biz_s3)",
    "cands": "cands AS (SELECT * FROM biz_s2 UNION ALL SELECT * FROM biz_s3)",
    "n0": f"n0 AS (SELECT entity_id, business_name AS name, business_address AS addr, country, {norm_name('business_name')} AS norm_name, {norm_addr('business_address')} AS norm_addr FROM ents)",
    "norm": f"norm AS (SELECT *, {comp_name('norm_name')} AS comp_name FROM n0)",
    "n1": "n1 AS (SELECT entity_id AS s1_id, * EXCLUDE (entity_id) FROM norm WHERE entity_id LIKE 'S1-%')",
    "nc": "nc AS (SELECT entity_id AS cid, * EXCLUDE (entity_id) FROM norm WHERE entity_id NOT LIKE 'S1-%')",
    "addr_df": f"addr_df AS (SELECT country, token, count(*) AS df FROM (SELECT country, unnest({anchors('norm_addr')}) AS token FROM nc) GROUP BY 1, 2)",
    "ranked_words": f"ranked_words AS (SELECT entity_id, token, df, row_number() OVER (PARTITION BY entity_id ORDER BY df, token) AS r FROM (SELECT w.entity_id, w.token, coalesce(d.df, 0) AS df FROM (SELECT entity_id, country, unnest({anchors('norm_addr')}) AS token FROM norm) w LEFT JOIN addr_df d ON w.country = d.country AND w.token = d.token))",
    "rare": "rare AS (SELECT entity_id, list(token ORDER BY r) AS anchors FROM ranked_words WHERE r <= 2 GROUP BY entity_id)",
    "bones": f"bones AS ({skeleton_of('norm', words('norm_name'))})",
    "sk_pick": f"sk_pick AS (SELECT entity_id, list_sort(list(sk ORDER BY i)) AS sks FROM (SELECT w.entity_id, b.sk, w.i, row_number() OVER (PARTITION BY w.entity_id ORDER BY w.i) AS n FROM (SELECT entity_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT entity_id, {words('norm_name')} AS l FROM norm WHERE country = 'India')) w JOIN bones b ON w.t = b.t WHERE length(w.t) >= 3 AND length(b.sk) >= 3 AND b.sk NOT IN ({quoted(SKELETON_STOPWORDS)})) WHERE n <= 2 GROUP BY entity_id)",
    "kbase": f"kbase AS (SELECT n.entity_id, n.country, {distinctive('norm_name')} AS dt, list_sort({distinctive('norm_name')}) AS ds, {numbers('norm_addr')} AS nums, coalesce(r.anchors, []) AS a, s.sks FROM norm n LEFT JOIN rare r USING (entity_id) LEFT JOIN sk_pick s USING (entity_id))",
    "keys": """keys AS (SELECT DISTINCT entity_id, country, kind, key FROM (
      SELECT entity_id, country, 'tok' AS kind, 'tok_' || unnest(dt) AS key FROM kbase
      UNION ALL SELECT entity_id, country, 'tp', 'tp_' || ds[1] || '_' || ds[2] FROM kbase WHERE len(ds) >= 2
      UNION ALL SELECT entity_id, country, 'tp', 'tp_' || ds[1] || '_' || ds[3] FROM kbase WHERE len(ds) >= 3
      UNION ALL SELECT entity_id, country, 'tp', 'tp_' || ds[2] || '_' || ds[3] FROM kbase WHERE len(ds) >= 3
      UNION ALL SELECT entity_id, country, 'num', 'num_' || n || '_' || w FROM (SELECT entity_id, country, n, unnest(a) AS w FROM (SELECT entity_id, country, a, unnest(nums[1:3]) AS n FROM kbase))
      UNION ALL SELECT entity_id, country, 'zip', 'zip_' || n FROM (SELECT entity_id, country, unnest(nums) AS n FROM kbase) WHERE length(n) >= 4
      UNION ALL SELECT entity_id, country, 'bg', 'bg_' || least(a[1], a[2]) || '_' || greatest(a[1], a[2]) FROM kbase WHERE len(a) >= 2
      UNION ALL SELECT entity_id, country, 'sk', 'sk_' || array_to_string(sks, '_') FROM kbase WHERE sks IS NOT NULL))""",
    "wkeys": f"wkeys AS (SELECT entity_id, country, key, CASE kind {_weight} ELSE 2.0 END::DOUBLE AS weight FROM keys)",
    "ckeys": "ckeys AS (SELECT entity_id AS cid, country, key FROM wkeys WHERE entity_id NOT LIKE 'S1-%')",
    "probe": "probe AS (SELECT entity_id AS s1_id, country, key, weight FROM wkeys WHERE entity_id LIKE 'S1-%')",
    "hot": "hot AS (SELECT country, key, count(*) AS n FROM ckeys GROUP BY 1, 2 HAVING count(*) > {cap})",
    "post": "post AS (SELECT c.* FROM ckeys c WHERE NOT EXISTS (SELECT 1 FROM hot h WHERE h.country = c.country AND h.key = c.key))",
    "p_exact": "p_exact AS (SELECT s.s1_id, c.cid, 20.0::DOUBLE AS weight FROM n1 s JOIN nc c ON s.country = c.country AND s.norm_name = c.norm_name WHERE s.norm_name <> '' QUALIFY row_number() OVER (PARTITION BY s.s1_id ORDER BY c.cid) <= 30)",
    "p_comp": "p_comp AS (SELECT s.s1_id, c.cid, 15.0::DOUBLE AS weight FROM n1 s JOIN nc c ON s.country = c.country AND s.comp_name = c.comp_name WHERE s.comp_name <> '' QUALIFY row_number() OVER (PARTITION BY s.s1_id ORDER BY c.cid) <= 30)",
    "p_key": "p_key AS (SELECT p.s1_id, k.cid, sum(p.weight) AS weight FROM probe p JOIN post k ON p.country = k.country AND p.key = k.key GROUP BY 1, 2)",
    "pool_": "pool_ AS (SELECT s1_id, cid, sum(weight) AS weight FROM (SELECT * FROM p_exact UNION ALL SELECT * FROM p_comp UNION ALL SELECT * FROM p_key) GROUP BY 1, 2)",
    "top_": "top_ AS (SELECT s1_id, cid, weight, row_number() OVER (PARTITION BY s1_id ORDER BY weight DESC, cid) AS rank FROM pool_ QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY weight DESC, cid) <= {k})",
    "att": "att AS (SELECT t.s1_id, t.cid, t.weight, t.rank, s.country, s.name AS s1_name, s.addr AS s1_addr, s.norm_name AS sn, s.norm_addr AS sa, c.name AS cand_name, c.addr AS cand_addr, c.norm_name AS cn, c.norm_addr AS ca FROM top_ t JOIN n1 s USING (s1_id) JOIN nc c USING (cid))",
    "lists": f"lists AS (SELECT *, {words('sn')} AS snw, {words('cn')} AS cnw, {words('sa')} AS saw, {words('ca')} AS caw, {numbers('s1_addr')} AS a, {numbers('cand_addr')} AS b FROM att)",
    "feat": f"feat AS (SELECT *, {jaccard('snw', 'cnw')} AS name_jaccard, {jaccard('saw', 'caw')} AS addr_jaccard, {_num.format(none='1.0', both='len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE')} AS num_jaccard FROM lists)",
    "skel": f"skel AS (SELECT s1_or_c, array_to_string(list(b.sk ORDER BY w.i), ' ') AS bone FROM (SELECT s1_or_c, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT DISTINCT norm_name AS s1_or_c, {words('norm_name')} AS l FROM norm)) w JOIN bones b USING (t) WHERE length(w.t) >= 3 GROUP BY 1)",
    "strings": "strings AS (SELECT sn AS x, cn AS y FROM att UNION SELECT sa, ca FROM att)",
    "bone_strings": "bone_strings AS (SELECT DISTINCT coalesce(p.bone, '') AS x, coalesce(q.bone, '') AS y FROM att LEFT JOIN skel p ON p.s1_or_c = sn LEFT JOIN skel q ON q.s1_or_c = cn)",
    "spelled": _spelled("spelled", "strings"),
    "bone_spelled": _spelled("bone_spelled", "bone_strings"),
    "token_sets": _token_sets("token_sets", "spelled"),
    "bone_sets": _token_sets("bone_sets", "bone_spelled"),
    "ratios": f"ratios AS ({ratio_of('SELECT x, y FROM strings UNION ALL SELECT x_sorted, y_sorted FROM spelled')})",
    "partials": f"partials AS ({partial_of('SELECT x, y FROM strings')})",
    "scores": "scores AS (SELECT s1_id, cid, rank, country, round((name_jaccard + addr_jaccard + num_jaccard) / 3, 4) AS prob FROM feat)",
    "rescored": f"scores AS (SELECT s1_id, cid, place AS rank, country, round((name_jaccard + addr_jaccard + num_jaccard) / 3, 4) AS prob FROM (SELECT feat.*, row_number() OVER (PARTITION BY s1_id ORDER BY {RERANK} DESC, cid) AS place FROM feat {RERANK_SETS}) WHERE place <= 35)",
    "cum": "cum AS (SELECT s1_id, cid, prob, rank, row_number() OVER w AS k, sum(prob) OVER (PARTITION BY s1_id ORDER BY prob DESC, rank ROWS UNBOUNDED PRECEDING) AS s FROM scores WINDOW w AS (PARTITION BY s1_id ORDER BY prob DESC, rank))",
    "tot": "tot AS (SELECT s1_id, sum(prob) AS t, max(prob) AS top, product(1 - prob) AS none, count(*) AS n FROM scores GROUP BY 1)",
    "fk": "fk AS (SELECT c.s1_id, c.k, 1.25 * c.s / (0.25 * t.t + c.k) AS f, t.top, t.none, t.n FROM cum c JOIN tot t USING (s1_id))",
    "pick": "pick AS (SELECT s1_id, CASE WHEN any_value(top) < 0.7 OR any_value(none) >= max(f) THEN 0 ELSE arg_max(k, ROW(f, -k)) END::INTEGER AS k, any_value(n) AS n FROM fk GROUP BY 1)",
    "accepted": "accepted AS (SELECT c.s1_id, c.cid, c.prob FROM cum c JOIN pick p USING (s1_id) WHERE c.k <= p.k)",
    "winners": "winners AS (SELECT cid, s1_id, prob FROM scores QUALIFY row_number() OVER (PARTITION BY cid ORDER BY prob DESC, s1_id) = 1)",
    "final": "final AS (SELECT a.s1_id, a.cid FROM accepted a LEFT JOIN winners w USING (cid) WHERE w.s1_id IS NULL OR w.s1_id = a.s1_id)",
    "ceiling": "ceiling AS (SELECT s1_id, cid FROM top_ JOIN biz_truth USING (s1_id, cid))",
    "ef": "ef AS (SELECT s.s1_id, s.country, coalesce(t.n, 0) AS n_true, coalesce(p.n, 0) AS n_pred, coalesce(b.n, 0) AS n_both FROM n1 s LEFT JOIN (SELECT s1_id, count(*) n FROM biz_truth GROUP BY 1) t USING (s1_id) LEFT JOIN (SELECT s1_id, count(*) n FROM {pred} GROUP BY 1) p USING (s1_id) LEFT JOIN (SELECT s1_id, count(*) n FROM {pred} JOIN biz_truth USING (s1_id, cid) GROUP BY 1) b USING (s1_id))",
    "ef5": "ef5 AS (SELECT *, CASE WHEN n_true = 0 THEN (n_pred = 0)::INTEGER::DOUBLE WHEN n_pred = 0 OR n_both = 0 THEN 0.0 ELSE 1.25 * (n_both / n_pred) * (n_both / n_true) / (0.25 * (n_both / n_pred) + n_both / n_true) END AS f05 FROM ef)",
    "indic": f"indic AS (SELECT s.entity_id AS s1_id, s.w AS latin, translate(s.w, '{LETTERS}', '{DEVANAGARI}') AS indic FROM (SELECT 'S1-' || cast(k AS string) AS entity_id, lower(w1 || ' ' || p_name) AS w, country FROM base WHERE k % 2 = 0) s WHERE s.country = 'India')",
    "dict": "dict AS (SELECT word, latin, n FROM (SELECT word, latin, count(*) AS n FROM (SELECT unnest(string_split(indic, ' ')) AS word, unnest(string_split(latin, ' ')) AS latin FROM indic) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, latin) = 1)",
}


def _needs(name: str) -> list[str]:
    body = CTE[name].split(" AS (", 1)[1]
    return [x for x in CTE if x != name and re.search(rf"\b{re.escape(x)}\b", re.sub(r"'[^']*'", "", body))]


def sql(body: str, cap: int = 150, k: int = 35, pred: str = "final", rerank: bool = False) -> str:
    """``body`` after the expressions it needs, in the order of the table above; with ``rerank``, scores of the pairs that the text rerank keeps."""
    wanted: set[str] = set()
    todo = [x for x in CTE if re.search(rf"\b{re.escape(x)}\b", re.sub(r"'[^']*'", "", body))]
    while todo:
        name = todo.pop()
        name = "rescored" if rerank and name == "scores" else name
        if name not in wanted:
            wanted.add(name)
            todo += _needs(name) + ([pred] if name == "ef" else [])
    order = [x for x in CTE if x in wanted]
    # definitions come after what they use; the table is in that order
    filled = ", ".join(CTE[x].replace("{cap}", str(cap)).replace("{k}", str(k)).replace("{pred}", pred) for x in order)
    return f"WITH {filled} {body}" if order else body
