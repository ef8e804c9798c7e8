"""Registered queries of the engine's own operators, each with its SQL for DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import frontmatter, markdown, scalar, text
from marginalia.operators import audit, delta, graph, incremental, move, quality, resolve, search, status
from marginalia.sources import notes as ingest
from marginalia.sources import vault
from marginalia.plans.adapters import SUBWORDS, Views, subwords_sql, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RETIRED = "coalesce(status, 'active') NOT IN ('deprecated', 'abandoned')"
MULT = "(CASE trust_tier WHEN 'human-reviewed' THEN 2.0 WHEN 'machine-confirmed' THEN 1.2 ELSE 1.0 END::double * CASE status WHEN 'draft' THEN 0.9 WHEN 'completed' THEN 0.85 WHEN 'deprecated' THEN 0.4 WHEN 'abandoned' THEN 0.4 ELSE 1.0 END::double * CASE layer WHEN 'archive' THEN 0.5 ELSE 1.0 END::double)"


def query(name: str, sql: str | None):
    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


# ------------------------------------------------------------------ scalars


@query("path_algebra", "SELECT cid, rel_path, regexp_replace(CASE WHEN layer = 'raw' THEN rel_path ELSE left(rel_path, length(rel_path) - 3) END, '^x', 'x') AS cid_of, split_part(rel_path, '/', 1) AS layer_of, stem AS stem_of, rel_path AS path_of FROM notes")
def path_algebra(v: Views) -> DataFrame:
    p = F.concat(F.lit("/"), F.replace("rel_path", F.lit("/"), F.lit("\\")))
    return v.heads.select("cid", "rel_path", scalar.cid_of(p).alias("cid_of"), scalar.layer_of(p).alias("layer_of"), scalar.stem_of(p).alias("stem_of"), scalar.path_of(F.col("cid")).alias("path_of"))


#: Paths of every fault, with parts that vary.
_ODD = "CASE doc_id % 13 WHEN 0 THEN stem || '.md' WHEN 1 THEN 'raw/' || stem || '.md' WHEN 2 THEN layer || '/.' || stem || '/x.md' WHEN 3 THEN layer || '/../' || stem || '.md' WHEN 4 THEN rel_path || '.txt' WHEN 5 THEN layer || '/.' || stem || '.md' WHEN 6 THEN layer || '//' || stem || '.md' WHEN 7 THEN layer || '~' || stem || '.md' WHEN 8 THEN '/' || rel_path WHEN 9 THEN layer || '/AGENTS.md' WHEN 10 THEN 'templates/' || stem || '.md' WHEN 11 THEN 'wiki/a/' || stem || '.md' ELSE rel_path END"
_LAST = "regexp_extract(p, '[^/]*$')"


@query(
    "path_violation",
    f"""SELECT doc_id, CASE WHEN p = '' OR starts_with(p, '/') THEN 'absolute' WHEN NOT contains(p, '/') OR len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) > 0 THEN 'root'
    WHEN regexp_matches(p, '(^|/)[.][^/]*/') THEN 'hidden' WHEN regexp_matches(p, '^(raw|log)/') THEN 'reserved' WHEN starts_with(p, 'templates/') THEN 'template' WHEN {_LAST} = 'AGENTS.md' THEN 'manifest'
    WHEN starts_with({_LAST}, '.') OR NOT ends_with(p, '.md') THEN 'suffix' WHEN regexp_matches(p, '^wiki/.*/') THEN 'nested' END AS violation FROM (SELECT doc_id, replace({_ODD}, '~', '/') AS p FROM notes) x""",
)
def path_violation(v: Views) -> DataFrame:
    return v.heads.select("doc_id", F.replace(F.expr(_ODD), F.lit("~"), F.lit("\\")).alias("p")).select("doc_id", scalar.path_violation(F.col("p"), "templates", for_write=True).alias("violation"))


_TAG = "concat(upper(substr(lang, 1, 1)), substr(lang, 2), CASE WHEN doc_id % 3 = 0 THEN '__' ELSE '_' END, source, CASE WHEN doc_id % 4 = 0 THEN '-' ELSE '' END)"


@query("canonical_tags", f"SELECT doc_id, array_to_string(list_filter([t, lang, CASE WHEN t2 NOT IN (t, lang) THEN t2 END], lambda x: x IS NOT NULL AND x <> ''), ' ') AS tags FROM (SELECT doc_id, lang, trim(regexp_replace(lower({_TAG}), '_+', '-', 'g'), '-') AS t, trim(regexp_replace(lower('_' || upper(source) || '__1'), '_+', '-', 'g'), '-') AS t2 FROM documents) x")
def canonical_tags(v: Views) -> DataFrame:
    raw = F.array(F.expr(_TAG), F.upper("lang"), F.lit("--"), F.concat(F.lit("_"), F.upper("source"), F.lit("__1")), F.col("lang"))
    return v["documents"].select("doc_id", F.array_join(scalar.canonical_tags(raw), " ").alias("tags"))


@query("actor_valid", "SELECT doc_id, ver_by, coalesce(regexp_full_match(ver_by, '(human|agent|process):[A-Za-z0-9._/-]+'), false) AS valid FROM notes")
def actor_valid(v: Views) -> DataFrame:
    return v.heads.select("doc_id", "ver_by", scalar.valid_actor(F.col("ver_by")).alias("valid"))


@query("timestamp_valid", "SELECT doc_id, try_cast(replace(replace(ver_at, 'T', ' '), 'Z', '') AS timestamp) IS NOT NULL AS valid FROM notes")
def timestamp_valid(v: Views) -> DataFrame:
    return v.heads.select("doc_id", scalar.valid_timestamp(F.col("ver_at")).alias("valid"))


_TITLE = "concat('  ', p_name, ' -- (', p_brand, ')_', CASE WHEN p_partkey % 7 = 0 THEN 'Größe é' ELSE '' END, ' - ')"


@query("slugify", f"SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g')), '[-\\s_]+', '-', 'g'), '-'), ''), 'untitled') AS slug FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '--- (!) ' ELSE {_TITLE} END AS t FROM part) x")
def slugify(v: Views) -> DataFrame:
    title = F.when(F.col("p_partkey") % 11 == 0, F.lit("--- (!) ")).otherwise(F.expr(_TITLE))
    return v["part"].select("p_partkey", scalar.file_stem(title).alias("slug"))


@query("body_hash", r"SELECT doc_id, 'sha256:' || sha256(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\r\f\v]+(\n|\z)', '\1', 'g'), '\A\n+|\n+\z', '', 'g')) AS body_hash FROM documents")
def body_hash(v: Views) -> DataFrame:
    return v["documents"].select("doc_id", scalar.body_hash(F.col("text")).alias("body_hash"))


@query("trust_tier", "SELECT cid, trust_tier FROM notes")
def trust_tier(v: Views) -> DataFrame:
    return v.notes.select("cid", "trust_tier")


@query("epistemic_multiplier", f"SELECT cid, round({MULT}, 4) AS m FROM notes")
def epistemic_multiplier(v: Views) -> DataFrame:
    return v.notes.select("cid", F.round(search.multiplier(), 4).alias("m"))


# ------------------------------------------------------------------ search

TOKENS = "regexp_extract_all(lower(strip_accents(coalesce({}, ''))), '[\\p{{L}}\\p{{N}}]+')"
COLUMNS = {"title": 4.0, "description": 2.0, "body": 1.0, "tags": 1.5, "aliases": 2.5, "subwords": 1.0}
#: What the words of the queries below stem to, as patterns of the words that share the stem.
THSH, THBLE, INEA, THE, OF, QUE, IN = "thshs?", "thble(s|ing)?", "inea(e|s|es|ed|ing|eds|ings)?", "the(s|ing)?", "of(s|e|es|ed|ing)?", "que(s|ing)?", "in(s|e|es|ed|ing)?"


def match_sql(leaves: list[tuple[tuple[str, ...], bool]], holds: str, layer: str = "layer <> 'raw'") -> str:
    """CTEs `scored` (columns of notes, score without multipliers) for leaves (patterns of words, prefix) and a condition over n_0, n_1, ..."""

    def count(column: str, words: tuple[str, ...], prefix: bool) -> str:
        hit = lambda x, w, last: f"starts_with({x}, '{w}')" if last and prefix else f"regexp_full_match({x}, '{w}')"
        if len(words) == 1:
            return f"len(list_filter(t_{column}, lambda x: {hit('x', words[0], True)}))"
        each = " AND ".join(hit(f"t_{column}[i + {k}]", w, k == len(words) - 1) for k, w in enumerate(words))
        return f"len(list_filter(range(1, len(t_{column}) + 1), lambda i: coalesce({each}, false)))"

    cols = list(COLUMNS)
    toks = ", ".join(f"{TOKENS.format(c)} AS t_{c}" for c in cols)
    tf = ", ".join(f"{count(c, w, p)} AS f_{i}_{c}" for i, (w, p) in enumerate(leaves) for c in cols)
    n = [" + ".join(f"f_{i}_{c}" for c in cols) for i in range(len(leaves))]
    stats = ", ".join(f"sum(CASE WHEN {x} > 0 THEN 1 ELSE 0 END) AS df_{i}" for i, x in enumerate(n))
    score = []
    for i in range(len(leaves)):
        f = "(" + " + ".join(f"f_{i}_{c} * {w}::double" for c, w in COLUMNS.items()) + ")"
        idf = f"ln((big_n - df_{i} + 0.5) / (df_{i} + 0.5))"
        score.append(f"CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END * {f} * 2.2::double / ({f} + 1.2::double * (0.25::double + 0.75::double * dl / (big_d / big_n)))")
    floor = [f"CASE WHEN {' OR '.join(f'f_{i}_{c} > 0' for i in range(len(leaves)))} THEN {0.05 * w}::double ELSE 0 END" for c, w in COLUMNS.items()]
    return f"""WITH toks AS (SELECT *, {toks} FROM notes WHERE parse_error IS NULL AND {layer}),
tf AS (SELECT * EXCLUDE ({', '.join(f't_{c}' for c in cols)}), ({' + '.join(f'len(t_{c})' for c in cols)})::double AS dl, {tf} FROM toks),
stats AS (SELECT count(*)::double AS big_n, sum(dl)::double AS big_d, {stats} FROM tf),
hits AS (SELECT *, {', '.join(f'{x} > 0 AS n_{i}' for i, x in enumerate(n))} FROM tf),
scored AS (SELECT *, {' + '.join([*score, *floor])} AS score FROM hits, stats WHERE {holds})"""


#: Mixed-case words of every shape, from a part's columns.
_MIXED = "concat(replace(p_brand, '#', ''), 'SoA', substr(p_name, 1, 4), 'XMLHttp', p_size, 'Req ', p_type, 'FP', p_partkey, 'aBc')"


def one(word: str) -> tuple[tuple[str, ...], bool]:
    return (word,), False


@query("filter_only_search", f"SELECT cid, title, type, status, trust_tier, round({MULT}, 4) AS score, coalesce(nullif(description, ''), substr(body, 1, 120), '') AS snippet FROM notes WHERE parse_error IS NULL AND layer <> 'raw' ORDER BY score DESC, cid LIMIT 20")
def filter_only_search(v: Views) -> DataFrame:
    return rounded(search.filter_only(v.notes, 20), "score")


@query("tag_filter", "SELECT cid FROM notes WHERE parse_error IS NULL AND layer <> 'raw' AND instr(' ' || tags || ' ', ' en ') > 0")
def tag_filter(v: Views) -> DataFrame:
    return v.notes.where(search.filters(tag="EN")).select("cid")


@query("tokenize", f"SELECT doc_id, len(t)::bigint AS n, sha256(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents) x")
def tokenize(v: Views) -> DataFrame:
    t = text.tokens(F.col("text"))
    return v["documents"].select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("h"))


#: Texts with marks of their own after letters, old forms of letters, and characters of private use.
_ODD_TEXT = "replace(replace(replace(replace(text, 'e', 'e' || {c}(769)), 'n', 'n' || {c}(771)), 'is', 'i' || {c}(383)), 'to', {c}(57344) || 'to')"


@query("tokenize_folded", f"SELECT doc_id, len(t)::bigint AS n, sha256(array_to_string(t, ' ')) AS h FROM (SELECT doc_id, regexp_extract_all(replace(lower(strip_accents({_ODD_TEXT.format(c='chr')})), chr(383), 's'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS t FROM documents) x")
def tokenize_folded(v: Views) -> DataFrame:
    t = text.tokens(F.expr(re.sub(r"\{c\}\((\d+)\)", lambda m: f"'{chr(int(m[1]))}'", _ODD_TEXT)))
    return v["documents"].select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("h"))


@query("term_df", f"SELECT term, count(DISTINCT cid)::bigint AS df, count(*)::bigint AS tf FROM (SELECT cid, unnest({TOKENS.format('body')}) AS term FROM notes WHERE parse_error IS NULL) x GROUP BY term")
def term_df(v: Views) -> DataFrame:
    return search.term_statistics(v.notes)


def _match(name: str, q: str, leaves: list, holds: str) -> None:
    query(name, match_sql(leaves, holds) + " SELECT cid, round(score, 4) AS score FROM scored")(lambda v: rounded(search.match(v.index, q), "score"))


_match("match_and", "the thsh", [one(THE), one(THSH)], "n_0 AND n_1")
_match("match_or", "thsh OR thbleing", [one(THSH), one(THBLE)], "n_0 OR n_1")
_match("match_not", "thes AND NOT thsh", [one(THE), one(THSH)], "n_0 AND NOT n_1")
_match("match_phrase", '"of the"', [((OF, THE), False)], "n_0")
_match("match_prefix", "thbl*", [(("thbl",), True)], "n_0")
_match("match_mixed", "que OR ining the NOT thsh", [one(QUE), one(IN), one(THE), one(THSH)], "n_0 OR (n_1 AND (n_2 AND NOT n_3))")
_match("match_subword", "crashloop", [one("crashloop")], "n_0")


@query("bm25_topk", match_sql([one(THSH), one(THBLE)], "n_0 OR n_1") + f" SELECT cid, title, type, status, trust_tier, round(score * {MULT}, 4) AS score FROM scored ORDER BY score * {MULT} DESC, cid LIMIT 20")
def bm25_topk(v: Views) -> DataFrame:
    return rounded(search.top(v.index, "thsh OR thble", 20), "score")


def tiers_sql(*tiers: tuple[int, list, str], limit: int) -> str:
    """The tiers (number, leaves, condition) one after the other, each note once."""
    parts, rows = [], []
    for k, leaves, holds in tiers:
        part = match_sql(leaves, holds)[len("WITH ") :]
        for name in ("toks", "stats", "hits", "scored", "tf"):
            part = re.sub(rf"\b{name}\b", f"{name}_{k}", part)
        parts.append(part)
        rows.append(f"SELECT cid, score * {MULT} AS score, {k} AS tier FROM scored_{k}")
    return f"""WITH {", ".join(parts)}, tiers AS ({" UNION ALL ".join(rows)}),
firsts AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY tier) AS k FROM tiers)
SELECT cid, round(score, 4) AS score, tier FROM firsts WHERE k = 1 ORDER BY tier, firsts.score DESC, cid LIMIT {limit}"""


@query("search_tiered", tiers_sql((0, [one(THSH), one(INEA)], "n_0 AND n_1"), (2, [one(THSH), one(INEA)], "n_0 OR n_1"), limit=50))
def search_tiered(v: Views) -> DataFrame:
    return rounded(search.search(v.index, "thsh inea", 50), "score").select("cid", "score", "tier")


#: As many as a search may give, so that the tier of the word's parts is needed where few notes hold the word.
@query("search_camel", tiers_sql((0, [one("crashloopbackoff")], "n_0"), (1, [one(w) for w in ("crash", "loop", "back", "off")], "n_0 AND n_1 AND n_2 AND n_3"), limit=search.MOST))
def search_camel(v: Views) -> DataFrame:
    return rounded(search.search(v.index, "CrashLoopBackOff", search.MOST), "score").select("cid", "score", "tier")


@query("camel_subwords", f"SELECT cid, array_to_string({SUBWORDS}, ' ') AS subwords FROM notes UNION ALL SELECT p_partkey::varchar, array_to_string({subwords_sql(_MIXED)}, ' ') FROM part")
def camel_subwords(v: Views) -> DataFrame:
    joined = lambda t: F.array_join(F.array_sort(text.camel_subwords(t)), " ").alias("subwords")
    return v.notes.select("cid", joined(F.concat_ws(" ", "title", "description", "alias", "body"))).unionByName(v["part"].select(F.col("p_partkey").cast("string").alias("cid"), joined(F.expr(_MIXED))))


SQL_INTEGRITY = f"SELECT 0::bigint AS missing, 0::bigint AS extra, count(*)::bigint AS total FROM (SELECT DISTINCT cid, c, term FROM ({' UNION ALL '.join(f'SELECT cid, {k} AS c, unnest({TOKENS.format(c)}) AS term FROM notes WHERE parse_error IS NULL' for k, c in enumerate(COLUMNS))}) x) y"


@query("index_integrity", SQL_INTEGRITY)
def index_integrity(v: Views) -> DataFrame:
    return search.integrity(v.index)


# ------------------------------------------------------------------ graph

PART = "part/2"


@query("neighborhood_fwd", "SELECT target_cid, sum(occurrences)::bigint AS occurrences FROM v_links WHERE source_cid = 'order/1' GROUP BY 1")
def neighborhood_fwd(v: Views) -> DataFrame:
    return graph.forward(v["v_links"], "order/1")


@query("neighborhood_back", f"SELECT source_cid, sum(occurrences)::bigint AS occurrences FROM v_links WHERE target_cid = '{PART}' GROUP BY 1")
def neighborhood_back(v: Views) -> DataFrame:
    return graph.back(v["v_links"], PART)


@query("two_hop_fwd", "WITH e AS (SELECT DISTINCT source_cid AS s, target_cid AS t FROM v_links WHERE target_cid IS NOT NULL), a AS (SELECT t FROM e WHERE s = 'order/1') SELECT DISTINCT t AS cid FROM e WHERE s IN (SELECT t FROM a) AND t <> 'order/1' AND t NOT IN (SELECT t FROM a)")
def two_hop_fwd(v: Views) -> DataFrame:
    return graph.two_hop(v["v_links"], "order/1")


@query("two_hop_back", "WITH e AS (SELECT DISTINCT source_cid AS s, target_cid AS t FROM v_links WHERE target_cid IS NOT NULL), a AS (SELECT s FROM e WHERE t = 'nation/3') SELECT DISTINCT s AS cid FROM e WHERE t IN (SELECT s FROM a) AND s <> 'nation/3' AND s NOT IN (SELECT s FROM a)")
def two_hop_back(v: Views) -> DataFrame:
    return graph.two_hop(v["v_links"], "nation/3", towards=False)


_PAIRS = "WITH e AS (SELECT DISTINCT {k} AS k, {v} AS v FROM {t} WHERE target_cid IS NOT NULL) SELECT x.v AS a, y.v AS b, count(*)::bigint AS n FROM e x JOIN e y ON x.k = y.k AND x.v {op} y.v {where} GROUP BY 1, 2 {having}"


@query("co_citation", _PAIRS.format(k="source_cid", v="target_cid", t="v_part_links", op="<", where="", having=""))
def co_citation(v: Views) -> DataFrame:
    return graph.co_citation(v["v_part_links"])


@query("co_citation_of", _PAIRS.format(k="source_cid", v="target_cid", t="v_part_links", op="<>", where=f"AND x.v = '{PART}'", having=""))
def co_citation_of(v: Views) -> DataFrame:
    return graph.co_citation(v["v_part_links"], PART)


@query("bib_coupling", _PAIRS.format(k="target_cid", v="source_cid", t="v_part_links", op="<", where="", having="HAVING count(*) >= 2"))
def bib_coupling(v: Views) -> DataFrame:
    return graph.coupling(v["v_part_links"], least=2)


@query("moc_degree", "WITH e AS (SELECT DISTINCT source_cid AS s, target_cid AS t FROM v_links WHERE target_cid IS NOT NULL AND source_cid <> target_cid), h AS (SELECT 'supplier/' || s_suppkey AS cid FROM supplier) SELECT cid, (SELECT count(*) FROM e WHERE s = cid)::bigint AS outgoing, (SELECT count(*) FROM e WHERE t = cid)::bigint AS incoming FROM h")
def moc_degree(v: Views) -> DataFrame:
    return graph.hub_degrees(v["supplier"].select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("cid")), v["v_links"])


@query("moc_overlap", "WITH e AS (SELECT DISTINCT source_cid AS s, target_cid AS t FROM v_hub_links), z AS (SELECT s, count(*) AS n FROM e GROUP BY 1) SELECT x.s AS a, y.s AS b, count(*)::bigint AS shared, least(min(za.n), min(zb.n))::bigint AS smaller FROM e x JOIN e y ON x.t = y.t AND x.s < y.s JOIN z za ON za.s = x.s JOIN z zb ON zb.s = y.s GROUP BY 1, 2")
def moc_overlap(v: Views) -> DataFrame:
    return graph.hub_overlap(v["supplier"].select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("cid")), v["v_hub_links"])


_NEAR = f"""WITH e AS (SELECT DISTINCT source_cid AS s, target_cid AS t FROM v_links WHERE target_cid IS NOT NULL),
f1 AS (SELECT t AS cid, (SELECT sum(occurrences) FROM v_links WHERE source_cid = '{PART}' AND target_cid = t) AS n FROM e WHERE s = '{PART}'),
b1 AS (SELECT source_cid AS cid, sum(occurrences) AS n FROM v_links WHERE target_cid = '{PART}' GROUP BY 1),
f2 AS (SELECT e.t AS cid, count(*) AS n FROM e JOIN f1 ON e.s = f1.cid WHERE e.t <> '{PART}' AND e.t NOT IN (SELECT cid FROM f1) GROUP BY 1),
b2 AS (SELECT e.s AS cid, count(*) AS n FROM e JOIN b1 ON e.t = b1.cid WHERE e.s <> '{PART}' AND e.s NOT IN (SELECT cid FROM b1) GROUP BY 1),
cc AS (SELECT y.t AS cid, count(*) AS n FROM e x JOIN e y ON x.s = y.s WHERE x.t = '{PART}' AND y.t <> '{PART}' GROUP BY 1),
cp AS (SELECT y.s AS cid, count(*) AS n FROM e x JOIN e y ON x.t = y.t WHERE x.s = '{PART}' AND y.s <> '{PART}' GROUP BY 1),
every AS (SELECT 'forward' AS kind, * FROM f1 UNION ALL SELECT 'back', * FROM b1 UNION ALL SELECT 'forward_2', * FROM f2 UNION ALL SELECT 'back_2', * FROM b2 UNION ALL SELECT 'co_cited', * FROM cc UNION ALL SELECT 'coupled', * FROM cp),
ranked AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, cid)::int AS rank, count(*) OVER (PARTITION BY kind)::bigint AS total FROM every)
SELECT kind, rank, cid, n::bigint AS n, total, p_name AS title, p_type AS type, NULL AS status, p_brand AS trust_tier FROM ranked LEFT JOIN part ON cid = 'part/' || p_partkey WHERE rank <= 20"""


@query("note_graph", _NEAR)
def note_graph(v: Views) -> DataFrame:
    parts = v["part"].select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("cid"), F.col("p_name").alias("title"), F.col("p_type").alias("type"), F.lit(None).cast("string").alias("status"), F.col("p_brand").alias("trust_tier"))
    return graph.view(parts, v["v_links"], "neighborhood", PART)


@query("hub_overview", "WITH e AS (SELECT DISTINCT source_cid AS s, target_cid AS t FROM v_hub_links), z AS (SELECT s, count(*) AS n FROM e GROUP BY 1), pairs AS (SELECT x.s AS a, y.s AS b, count(*)::bigint AS shared, least(min(za.n), min(zb.n))::bigint AS smaller FROM e x JOIN e y ON x.t = y.t AND x.s < y.s JOIN z za ON za.s = x.s JOIN z zb ON zb.s = y.s GROUP BY 1, 2) SELECT *, shared / smaller AS ratio, count(*) OVER ()::bigint AS total FROM pairs ORDER BY ratio DESC, shared DESC, a, b LIMIT 20")
def hub_overview(v: Views) -> DataFrame:
    hubs = v["supplier"].select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("cid"), F.lit("wiki").alias("layer"), F.lit("moc").alias("type"), F.lit(None).cast("string").alias("parse_error"))
    return graph.hub_overview(hubs, v["v_hub_links"])


_REACH = "WITH RECURSIVE r(cid) AS (SELECT 'order/' || o_orderkey FROM orders UNION SELECT target_cid FROM v_links JOIN r ON source_cid = r.cid WHERE target_cid IS NOT NULL) SELECT cid FROM r"


@query("reachable", _REACH)
def reachable(v: Views) -> DataFrame:
    start = v["orders"].select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("cid"))
    return graph.reachable(start, v["v_links"])


@query("entry_points", "SELECT cid, stem, rel_path, layer, description FROM notes WHERE layer <> 'archive' AND type = 'moc' AND parse_error IS NULL")
def entry_points(v: Views) -> DataFrame:
    return graph.entry_points(v.notes)


_UNFILED = f"WITH RECURSIVE r(cid) AS (SELECT cid FROM notes WHERE layer <> 'archive' AND type = 'moc' AND parse_error IS NULL UNION SELECT target_cid FROM v_note_links JOIN r ON source_cid = r.cid WHERE target_cid IS NOT NULL) SELECT cid, stem, rel_path FROM notes WHERE layer = 'wiki' AND parse_error IS NULL AND {RETIRED} AND cid NOT IN (SELECT cid FROM r)"


@query("unfiled", _UNFILED)
def unfiled(v: Views) -> DataFrame:
    return graph.unfiled(v.notes, v["v_note_links"])


_ORPHANS = "SELECT cid, rel_path FROM notes WHERE layer = 'wiki' AND NOT EXISTS (SELECT 1 FROM v_note_links WHERE source_cid = cid) AND NOT EXISTS (SELECT 1 FROM v_note_links l WHERE l.target_cid = cid)"


@query("orphans", _ORPHANS)
def orphans(v: Views) -> DataFrame:
    return graph.orphans(v.notes, v["v_note_links"])


@query("unprocessed_raw", "SELECT rel_path FROM v_raw r WHERE NOT EXISTS (SELECT 1 FROM v_sources s WHERE s.resolved_path = r.rel_path)")
def unprocessed_raw(v: Views) -> DataFrame:
    return graph.unprocessed_raw(v["v_raw"], v["v_sources"])


@query("raw_citers", "SELECT DISTINCT 'order/' || o_orderkey AS cid, resolved_path FROM v_sources JOIN orders ON source_cid = 'order/' || o_orderkey WHERE resolved_path IS NOT NULL")
def raw_citers(v: Views) -> DataFrame:
    return graph.raw_citers(v["orders"].select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("cid")), v["v_sources"])


@query("broken_links", "SELECT source_cid, target_raw FROM v_links WHERE target_cid IS NULL")
def broken_links(v: Views) -> DataFrame:
    return v["v_links"].where("target_cid is null").select("source_cid", "target_raw")


_INDEX = """WITH c AS (SELECT DISTINCT cid, CASE WHEN cid LIKE 'wiki/%' THEN 0 WHEN cid LIKE 'archive/%' THEN 2 ELSE 1 END AS prio, string_split(cid, '/') AS p FROM v_names),
n AS (SELECT 'exact' AS kind, cid AS name, cid, prio FROM c UNION ALL SELECT 'exact', substr(cid, 6), cid, prio FROM c WHERE prio = 0
  UNION ALL SELECT 'suffix', array_to_string(p[2:], '/'), cid, prio FROM c WHERE len(p) >= 3 UNION ALL SELECT 'stem', p[-1], cid, prio FROM c),
i AS (SELECT kind, name, cid FROM (SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY prio, cid) AS k FROM n) x WHERE k = 1),
q AS (SELECT doc_id, probe, regexp_replace(regexp_replace(probe, '^/+|/+$', '', 'g'), '[.]md$', '') AS name FROM v_names)"""


@query("links_resolve", _INDEX + " SELECT doc_id, probe AS target_raw, coalesce(e.cid, s.cid, CASE WHEN instr(q.name, '/') = 0 THEN t.cid END) AS target_cid FROM q LEFT JOIN i e ON e.kind = 'exact' AND e.name = q.name LEFT JOIN i s ON s.kind = 'suffix' AND s.name = q.name LEFT JOIN i t ON t.kind = 'stem' AND t.name = q.name")
def links_resolve(v: Views) -> DataFrame:
    n = v["v_names"]
    return resolve.resolve(n.select("doc_id", F.col("probe").alias("target_raw")), n.select("cid").distinct()).select("doc_id", "target_raw", "target_cid")


@query("name_candidates", _INDEX + """, hit AS (SELECT DISTINCT q.name, i.cid FROM q JOIN i ON i.kind = 'exact' AND i.name = q.name),
rest AS (SELECT DISTINCT q.name, n.cid, n.prio FROM q JOIN n ON n.name = q.name AND n.kind = CASE WHEN instr(q.name, '/') > 0 THEN 'suffix' ELSE 'stem' END WHERE q.name NOT IN (SELECT name FROM hit))
SELECT name, cid FROM hit UNION ALL SELECT name, cid FROM rest WHERE prio < 2 OR name NOT IN (SELECT name FROM rest WHERE prio < 2)""")
def name_candidates(v: Views) -> DataFrame:
    n = v["v_names"]
    probe = F.regexp_replace(scalar.normal_path(F.col("probe")), r"\.md\z", "")
    return resolve.candidates(n.select(probe.alias("name")), n.select("cid").distinct())


@query("sources_resolve", "SELECT s.source_cid, s.raw_path, r.rel_path AS resolved_path FROM v_sources s LEFT JOIN v_raw r ON r.rel_path = s.raw_path")
def sources_resolve(v: Views) -> DataFrame:
    spelled = v["v_sources"].select("source_cid", "raw_path").withColumn("rel_path", scalar.normal_path(F.concat(F.lit("/"), F.replace("raw_path", F.lit("/"), F.lit("\\")))))
    return spelled.join(v["v_raw"].select("rel_path", F.col("rel_path").alias("resolved_path")), "rel_path", "left").select("source_cid", "raw_path", "resolved_path")


# ------------------------------------------------------------------ status

for _name, _column in (("status_by_layer", "layer"), ("status_by_tier", "trust_tier"), ("status_by_type", "type"), ("status_by_status", "status")):
    query(_name, f"SELECT {_column}, count(*)::bigint AS n FROM notes WHERE layer <> 'raw' GROUP BY 1")(lambda v, c=_column: status.by(v.notes if c == "trust_tier" else v.heads, c))

_DEBT = f"SELECT cid, ver_by = 'human:ann' AS human_owed FROM notes WHERE trust_tier = 'stale-verified' AND parse_error IS NULL AND layer <> 'archive' AND {RETIRED}"


@query("verification_debt", _DEBT)
def verification_debt(v: Views) -> DataFrame:
    return status.verification_debt(v.notes)


_TODO = "SELECT rel_path FROM notes n WHERE layer = 'raw' AND NOT EXISTS (SELECT 1 FROM v_note_sources s WHERE s.resolved_path = n.rel_path)"


@query("status_totals", f"SELECT count(*) FILTER (layer <> 'raw')::bigint AS total_notes, count(*) FILTER (layer = 'wiki')::bigint AS total_wiki, count(*) FILTER (layer = 'raw')::bigint AS total_raw, count(*) FILTER (layer <> 'raw' AND trust_tier = 'stale-verified')::bigint AS verification_debt, (SELECT count(*) FROM ({_TODO}) t)::bigint AS unprocessed_raw, (SELECT count(*) FROM v_note_links WHERE target_cid IS NULL)::bigint AS broken_links FROM notes")
def status_totals(v: Views) -> DataFrame:
    return status.totals(v.notes, v["v_note_links"], v["v_note_sources"])


@query("queues", _UNFILED.replace(" SELECT cid, stem, rel_path FROM notes WHERE layer = 'wiki'", ", u AS (SELECT cid FROM notes WHERE layer = 'wiki'") + f"), d AS ({_DEBT}) SELECT 'unfiled' AS queue, count(*)::bigint AS n FROM u UNION ALL SELECT 'raw', (SELECT count(*) FROM ({_TODO}) t) UNION ALL SELECT 'human_owed', (SELECT count(*) FROM d WHERE human_owed) UNION ALL SELECT 'agent_payable', (SELECT count(*) FROM d WHERE NOT human_owed)")
def queues(v: Views) -> DataFrame:
    return status.queues(v.notes, v["v_note_links"], v["v_note_sources"])


_LISTS = _UNFILED.replace(" SELECT cid, stem, rel_path FROM notes WHERE layer = 'wiki'", ", u AS (SELECT cid FROM notes WHERE layer = 'wiki'") + f"""), d AS ({_DEBT}),
every AS (SELECT 'unfiled' AS queue, cid AS item, NULL AS description FROM u UNION ALL SELECT 'raw', rel_path, NULL FROM ({_TODO}) t UNION ALL SELECT 'human_owed', cid, NULL FROM d WHERE human_owed UNION ALL SELECT 'agent_payable', cid, NULL FROM d WHERE NOT human_owed),
entries AS (SELECT 'entry_points' AS queue, cid AS item, description FROM notes WHERE layer <> 'archive' AND type = 'moc' AND parse_error IS NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY item)::int AS rank, count(*) OVER (PARTITION BY queue)::bigint AS total FROM (SELECT * FROM every UNION ALL SELECT * FROM entries) x)"""


@query("worklists", _LISTS + " SELECT queue, rank, item, total FROM ranked WHERE rank <= 25 AND queue <> 'entry_points'")
def worklists(v: Views) -> DataFrame:
    return status.worklists(v.notes, v["v_note_links"], v["v_note_sources"])


@query(
    "gap_report",
    _LISTS
    + r""", titles AS (SELECT unnest(['entry_points', 'unfiled', 'raw', 'human_owed', 'agent_payable']) AS queue, unnest(['Entry points', 'Unfiled notes', 'Raw files without citations', 'Reviews that a human owes', 'Reviews that an agent can do']) AS title),
    cells AS (SELECT ranked.*, title, regexp_replace(replace(coalesce(description, ''), '|', '\|'), '\s+', ' ', 'g') AS cell FROM ranked JOIN titles USING (queue) WHERE rank <= 25)
    SELECT queue AS part, 0::int AS pos, '## ' || title || ' (' || total || ')' AS line FROM cells WHERE rank = 1
    UNION ALL SELECT queue, rank + 1, '- ' || CASE WHEN queue = 'raw' THEN '`' || item || '`' ELSE '[[' || item || ']]' END || CASE WHEN cell <> '' THEN ': ' || cell ELSE '' END FROM cells
    UNION ALL SELECT queue, 27, '- and ' || (total - 25) || ' more' FROM cells WHERE rank = 25 AND total > 25""",
)
def gap_report(v: Views) -> DataFrame:
    return status.gap_report(v.notes, v["v_note_links"], v["v_note_sources"])


@query("filename_only_raw", "SELECT lower(regexp_extract(rel_path, '([.][^./]+)$', 1)) AS extension, count(*)::bigint AS n FROM (SELECT rel_path || CASE p_partkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' ELSE '' END AS rel_path FROM v_raw) x GROUP BY 1")
def filename_only_raw(v: Views) -> DataFrame:
    return status.raw_extensions(v["v_raw"].select(F.concat("rel_path", F.expr("CASE p_partkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' ELSE '' END")).alias("rel_path")))


# ------------------------------------------------------------------ quality

_RAW_PATH = "CASE WHEN s.cid LIKE 'wiki/deep/%' THEN 'wiki/' ELSE '' END || 'raw/d' || (s.doc_id + 1) || '.txt'"
_P = "notes WHERE parse_error IS NULL AND layer <> 'raw'"
GATES = {
    "lint_unparseable": "SELECT 'FRONTMATTER_UNPARSEABLE' AS code, 'error' AS severity, rel_path, parse_error AS message FROM notes WHERE layer <> 'raw' AND parse_error IS NOT NULL",
    "lint_field_missing": " UNION ALL ".join(f"SELECT 'FIELD_MISSING' AS code, 'error' AS severity, rel_path, 'Missing required field ''{c}''' AS message FROM {_P} AND coalesce(trim({c}), '') = ''" for c in ("type", "title", "description", "status")),
    "lint_enum_invalid": f"SELECT 'ENUM_INVALID' AS code, 'error' AS severity, rel_path, 'Invalid status ''' || status || '''' AS message FROM {_P} AND status = 'bogus' UNION ALL SELECT 'ENUM_INVALID', 'error', rel_path, 'Invalid type ''' || type || '''' FROM {_P} AND layer = 'projects' AND type NOT IN ('moc', 'concept', 'guide')",
    "lint_tag": f"SELECT 'TAG_MALFORMED' AS code, CASE WHEN tag = 'Bad Tag' THEN 'error' ELSE 'warning' END AS severity, rel_path, CASE WHEN tag = 'Bad Tag' THEN 'Tag with white space ''' ELSE 'Non-canonical tag ''' END || tag || '''' AS message FROM {_P} AND tag IN ('Bad Tag', 'Not_Canonical')",
    "lint_alias": f"SELECT 'ENUM_INVALID' AS code, 'error' AS severity, rel_path, 'Alias that isn''t one line of text ''two lines''' AS message FROM {_P} AND doc_id % 53 = 0",
    "lint_manifest": "SELECT 'DOMAIN_MANIFEST_INVALID' AS code, 'error' AS severity, n_name || '/AGENTS.md' AS rel_path, CASE n_nationkey % 3 WHEN 1 THEN 'require_sources is neither true nor false; domain ''x'' isn''t the folder ''' || n_name || '''' ELSE 'its header can''t be read: tab in a header' END AS message FROM nation WHERE n_nationkey % 3 > 0",
    "lint_timestamp": f"SELECT 'TIMESTAMP_INVALID' AS code, 'error' AS severity, rel_path, 'generated.at: ''yesterday''' AS message FROM {_P} AND doc_id % 59 = 0 UNION ALL SELECT 'TIMESTAMP_INVALID' AS code, 'error' AS severity, rel_path, 'verified[0].at: ''' || ver_at || '''' AS message FROM {_P} AND ver_by IS NOT NULL AND ver_at LIKE '2024-13%'",
    "lint_anchor_missing": "SELECT 'ANCHOR_MISSING' AS code, 'warning' AS severity, s.rel_path, 'No heading ''Section 9'' in ' || t.cid AS message FROM v_md s JOIN v_md t ON t.doc_id = s.doc_id + 1 WHERE s.doc_id % 4 = 0",
    "lint_raw_link": f"SELECT 'RAW_LINK_BROKEN' AS code, 'error' AS severity, s.rel_path, 'No raw file ''../raw/d' || (s.doc_id + 1) || '.txt''' || CASE WHEN u.rel_path IS NULL THEN '' ELSE '; did you mean ''../../' || u.rel_path || '''?' END AS message FROM v_md s LEFT JOIN v_md t ON t.rel_path = {_RAW_PATH} LEFT JOIN v_md u ON u.layer = 'raw' AND u.doc_id = s.doc_id + 1 WHERE s.doc_id % 2 = 0 AND t.rel_path IS NULL",
    "lint_nesting": f"SELECT 'WIKI_NESTING_DISALLOWED' AS code, 'error' AS severity, rel_path, 'The wiki is flat' AS message FROM {_P} AND layer = 'wiki' AND rel_path LIKE 'wiki/deep/%'",
    "lint_link_dead": f"SELECT 'LINK_DEAD' AS code, 'error' AS severity, rel_path, 'Dead link ''' || target_raw || '''' || CASE WHEN near IS NULL THEN '' ELSE '; did you mean ' || near || '?' END AS message FROM v_note_links JOIN (SELECT cid, rel_path FROM {_P}) x ON cid = source_cid LEFT JOIN (SELECT string_split(cid, '/')[-1] AS name, array_to_string(list(cid ORDER BY cid)[1:3], ', ') AS near FROM {_P} GROUP BY 1) y ON name = string_split(target_raw, '/')[-1] WHERE target_cid IS NULL",
    "lint_source_missing": f"SELECT 'SOURCE_MISSING' AS code, 'error' AS severity, rel_path, 'No raw file ''' || raw_path || '''' AS message FROM v_note_sources JOIN (SELECT cid, rel_path FROM {_P}) x ON cid = source_cid WHERE resolved_path IS NULL UNION ALL SELECT 'SOURCE_MISSING', 'error', rel_path, 'Domain ''customers'' requires sources' FROM {_P} AND layer = 'customers' AND cid NOT IN (SELECT source_cid FROM v_note_sources)",
    "lint_orphan": f"SELECT 'NOTE_ORPHAN' AS code, 'warning' AS severity, rel_path, 'No link to or from this note' AS message FROM ({_ORPHANS}) x",
    "lint_verification": f"SELECT 'ACTOR_MALFORMED' AS code, 'error' AS severity, rel_path, 'Malformed actor ''nobody''' AS message FROM {_P} AND ver_by = 'nobody' UNION ALL SELECT 'VERIFICATION_STALE', 'warning', rel_path, 'Entry by ''' || ver_by || ''' is stale' FROM {_P} AND ver_by <> 'nobody' AND ver_stale = 1",
}


def allowed_types(v: Views) -> DataFrame:
    return v.spark.createDataFrame([("projects", ["moc", "concept", "guide"])], "layer string, allowed array<string>")


def manifests(v: Views) -> DataFrame:
    """A domain for each nation, with manifests of which two in three are broken."""
    faults = ("allowed_types:\n  - note\nrequire_sources: true", "domain: x\nrequire_sources: maybe", "a:\tb")
    domains = [vault.domain(r.n_name, f"---\n{faults[r.n_nationkey % 3]}\n---\nAs {r.n_name} does.") for r in v["nation"].collect()]
    return vault.domain_table(v.spark, domains)


def anchored(v: Views) -> tuple[DataFrame, DataFrame]:
    """Resolved links with anchors, and headings by note."""
    md = v.parsed
    edges = md.select("rel_path", F.explode("edges").alias("e")).where("e.kind = 'wiki'").select("rel_path", F.col("e.target").alias("stem"), "e.anchor")
    return edges.join(md.select("stem", F.col("cid").alias("target_cid")), "stem"), md.select("cid", "headings")


def into_raw(v: Views) -> tuple[DataFrame, DataFrame]:
    """Relative links, and raw files."""
    md = v.parsed
    links = md.select("rel_path", F.explode("links").alias("e")).where("e.kind = 'markdown'").select("rel_path", "e.target_raw")
    return links, md.where("layer = 'raw'").select(F.col("rel_path").alias("path"))


RUNS: dict[str, Callable[[Views], DataFrame]] = {
    "lint_unparseable": lambda v: quality.unparseable(v.heads),
    "lint_field_missing": lambda v: quality.fields(v.notes),
    "lint_enum_invalid": lambda v: quality.enums(v.heads, allowed_types(v)),
    "lint_tag": lambda v: quality.tags(v.heads),
    "lint_alias": lambda v: quality.aliases(v.heads),
    "lint_manifest": lambda v: quality.manifests(manifests(v)),
    "lint_anchor_missing": lambda v: quality.missing_anchors(*anchored(v)),
    "lint_raw_link": lambda v: quality.broken_raw_links(*into_raw(v)),
    "lint_timestamp": lambda v: quality.timestamps(v.notes),
    "lint_nesting": lambda v: quality.nesting(v.heads),
    "lint_link_dead": lambda v: quality.dead_links(v.notes, v["v_note_links"]),
    "lint_source_missing": lambda v: quality.missing_sources(v.notes, v["v_note_sources"], ["customers"]),
    "lint_orphan": lambda v: quality.orphan(v.notes, v["v_note_links"]),
    "lint_verification": lambda v: quality.verification(v.notes),
}
for _name, _run in RUNS.items():
    query(_name, GATES[_name])(_run)
_ALL = " UNION ALL ".join(f"SELECT * FROM ({g}) g{i}" for i, g in enumerate(GATES.values()))


def _lint(v: Views) -> DataFrame:
    return quality.lint(v.notes, v["v_note_links"], v["v_note_sources"], allowed_types(v), ["customers"], anchored(v), into_raw(v), manifests(v))


query("lint_all", _ALL)(_lint)
query("lint_counts", f"SELECT code, severity, count(*)::bigint AS n FROM ({_ALL}) x GROUP BY 1, 2")(lambda v: quality.counts(_lint(v)))

# ------------------------------------------------------------------ changes


@query("scan_delta", "SELECT coalesce(o.rel_path, n.rel_path) AS rel_path, CASE WHEN o.rel_path IS NULL THEN 'insert' WHEN n.rel_path IS NULL THEN 'delete' WHEN abs(o.mtime - n.mtime) <= 1e-4 AND o.file_size = n.file_size THEN 'same' ELSE 'update' END AS change FROM v_old o FULL OUTER JOIN v_new n ON o.rel_path = n.rel_path")
def scan_delta(v: Views) -> DataFrame:
    return delta.classify(v["v_old"], v["v_new"])


@query("pending_changes", "SELECT CASE WHEN b.rel_path IS NULL THEN 'insert' WHEN a.rel_path IS NULL THEN 'delete' WHEN a.mtime = b.mtime AND a.file_size = b.file_size AND a.settings = b.settings THEN 'same' ELSE 'update' END AS change, count(*)::bigint AS n FROM v_before b FULL OUTER JOIN v_after a ON a.rel_path = b.rel_path GROUP BY 1")
def pending_changes(v: Views) -> DataFrame:
    return delta.pending(v["v_before"], v["v_after"])


@query("snapshot_files", "SELECT a.rel_path, a.mtime, a.file_size, a.settings, a.parse_error IS NULL AS fine, CASE WHEN a.mtime = b.mtime AND a.file_size = b.file_size AND a.settings = b.settings THEN 1 ELSE 2 END::bigint AS segment FROM v_after a LEFT JOIN v_before b ON a.rel_path = b.rel_path")
def snapshot_files(v: Views) -> DataFrame:
    """The next snapshot, and which scan read each file."""
    store = v.followed
    return store.read(store.latest(), "files").select("rel_path", "mtime", "file_size", "settings", "fine", "segment")


_INTO_AFTER = _INDEX.split("q AS (")[0].replace("v_names", "v_after WHERE layer <> 'raw'")
_ASKED = r"""q AS (
  SELECT cid AS source_cid, layer, 'wiki' AS kind, by_name AS target, by_name AS name FROM v_after WHERE parse_error IS NULL AND layer <> 'raw'
  UNION ALL SELECT cid, layer, 'markdown', by_path, CASE WHEN starts_with(cid, 'wiki/deep/') THEN 'wiki/' ELSE '' END || regexp_extract(by_path, '^\.\./(.*)\.md$', 1) FROM v_after WHERE parse_error IS NULL AND layer <> 'raw'
), found AS (
  SELECT q.*, CASE WHEN q.kind = 'markdown' THEN p.cid ELSE coalesce(e.cid, s.cid, CASE WHEN instr(q.name, '/') = 0 THEN t.cid END) END AS hit
  FROM q LEFT JOIN i e ON e.kind = 'exact' AND e.name = q.name LEFT JOIN i s ON s.kind = 'suffix' AND s.name = q.name LEFT JOIN i t ON t.kind = 'stem' AND t.name = q.name LEFT JOIN c p ON p.cid = q.name
) SELECT source_cid, kind, target, CASE WHEN a.parse_error IS NULL THEN hit END AS target_cid FROM found LEFT JOIN v_after a ON a.cid = hit"""


@query("incremental_links", _INTO_AFTER + _ASKED)
def incremental_links(v: Views) -> DataFrame:
    """Both kinds of links after the changes, of which only names that changed notes answer to were looked up again."""
    store = v.followed
    return incremental.links(store, store.latest()).select("source_cid", "kind", "target", "target_cid")


_FROM_TEXTS = (
    _INDEX.split("q AS (")[0].replace("v_names", "v_notes WHERE layer <> 'raw'")
    + r"""q AS (
  SELECT cid AS source_cid, 'wiki' AS kind, 'd' || (doc_id + 1) AS target, 'next' AS alias, 2::bigint AS occurrences, 'd' || (doc_id + 1) AS name FROM v_md WHERE layer <> 'raw'
  UNION ALL SELECT cid, 'markdown', '../wiki/d' || (doc_id % 7) || '.md', 'file', 1, CASE WHEN starts_with(cid, 'wiki/deep/') THEN 'wiki/' ELSE '' END || 'wiki/d' || (doc_id % 7) FROM v_md WHERE layer <> 'raw'
  UNION ALL SELECT cid, 'wiki', common, NULL, CAST(links_in_text AS bigint), common FROM v_md WHERE layer <> 'raw' AND links_in_text > 0
), found AS (
  SELECT q.*, CASE WHEN q.kind = 'markdown' THEN p.cid ELSE coalesce(e.cid, s.cid, t.cid) END AS hit
  FROM q LEFT JOIN i e ON e.kind = 'exact' AND e.name = q.name LEFT JOIN i s ON s.kind = 'suffix' AND s.name = q.name LEFT JOIN i t ON t.kind = 'stem' AND t.name = q.name LEFT JOIN c p ON p.cid = q.name
) SELECT source_cid, found.kind, target, found.occurrences, CASE WHEN n.parse_error IS NULL THEN hit END AS target_cid FROM found LEFT JOIN v_notes n ON n.cid = hit"""
).replace(", 'next' AS alias", "").replace(", 'file', 1", ", 1").replace("common, NULL, CAST", "common, CAST")


@query("edges_resolve", _FROM_TEXTS)
def edges_resolve(v: Views) -> DataFrame:
    """Links of both kinds as the texts hold them, resolved in one plan; what means a note that can't be parsed is dead."""
    rows = v.parsed.where("layer <> 'raw'").select(F.col("cid").alias("source_cid"), F.explode("edges").alias("e")).select("source_cid", "e.kind", "e.target")
    written = rows.groupBy("source_cid", "kind", "target").agg(F.count("*").alias("occurrences"))
    notes = v["v_notes"].where("layer <> 'raw'")
    return resolve.edges(written, notes.select("cid"), notes.where("parse_error IS NOT NULL"))


def _after(sql: str) -> str:
    return sql.replace("FROM notes", "FROM v_after")


@query("incremental_search", _after(match_sql([one(THSH), one(THBLE), one(THE)], "n_0 OR (n_1 AND n_2)")) + " SELECT cid, round(score, 4) AS score FROM scored")
def incremental_search(v: Views) -> DataFrame:
    store = v.followed
    return rounded(search.match(incremental.index(store, store.latest()), "thsh OR thble AND the"), "score")


@query("incremental_integrity", _after(SQL_INTEGRITY))
def incremental_integrity(v: Views) -> DataFrame:
    store = v.followed
    return incremental.integrity(store, store.latest())


# ------------------------------------------------------------------ Markdown and headers

_CUTS = "SELECT *, instr(md, '## Section') AS a, instr(md, '## Last') AS b, length(md) AS n FROM v_md"


@query(
    "links_extract",
    """SELECT doc_id, 'wiki' AS kind, 'd' || (doc_id + 1) || '#' || wanted AS target_raw, 'd' || (doc_id + 1) AS target, wanted AS anchor, 2::bigint AS occurrences FROM v_md
    UNION ALL SELECT doc_id, 'markdown', '../wiki/d' || (doc_id % 7) || '.md#Top', '../wiki/d' || (doc_id % 7) || '.md', 'Top', 1 FROM v_md
    UNION ALL SELECT doc_id, 'wiki', common, common, NULL, CAST(links_in_text AS bigint) FROM v_md WHERE links_in_text > 0""",
)
def links_extract(v: Views) -> DataFrame:
    edges = v["v_md"].select("doc_id", F.explode(markdown.edge_array("md")).alias("e")).select("doc_id", "e.kind", "e.target_raw", "e.target", "e.anchor")
    return edges.groupBy("doc_id", "kind", "target_raw", "target", "anchor").agg(F.count("*").alias("occurrences"))


@query("headings", "SELECT doc_id, unnest([0, 1, 2, 3])::int AS pos, unnest([1, 2, 3, 2])::int AS level, unnest(['Note ' || doc_id, 'Section ' || (doc_id % 3), 'Deep x', 'Last']) AS title FROM v_md")
def headings(v: Views) -> DataFrame:
    return v["v_md"].select("doc_id", F.posexplode(markdown.heading_array("md")).alias("pos", "h")).select("doc_id", "pos", "h.level", "h.title")


@query("sections", f"SELECT doc_id, unnest([0, 1, 2])::int AS pos, unnest(['', 'Section ' || (doc_id % 3), 'Last']) AS heading, unnest([a - 1, b - a, n - b + 1])::int AS n_chars FROM ({_CUTS})")
def sections(v: Views) -> DataFrame:
    return v["v_md"].select("doc_id", F.posexplode(markdown.section_array("md")).alias("pos", "s")).select("doc_id", "pos", "s.heading", F.length("s.text").alias("n_chars"))


@query("section_extract", f"SELECT doc_id, 'Section ' || (doc_id % 3) AS heading, sha256(substr(md, a, b - a)) AS h FROM ({_CUTS})")
def section_extract(v: Views) -> DataFrame:
    anchor = F.concat(F.lit("SECTION%20"), (F.col("doc_id") % 3).cast("string"))
    return v["v_md"].select("doc_id", markdown.section_at("md", anchor).alias("s")).select("doc_id", "s.heading", F.sha2("s.text", 256).alias("h"))


@query("anchor_match", "SELECT doc_id, doc_id % 4 <> 3 AS matched FROM v_md")
def anchor_match(v: Views) -> DataFrame:
    k = (F.col("doc_id") % 3).cast("string")
    anchor = F.expr("element_at(array('Section ', 'section-', 'SECTION%20', 'none '), CAST(doc_id % 4 AS int) + 1)")
    rows = v["v_md"].select("doc_id", F.concat(anchor, k).alias("anchor"), markdown.heading_array("md").alias("hs"))
    return rows.select("doc_id", F.exists("hs", lambda h: markdown.names_heading(F.col("anchor"), h["title"])).alias("matched"))


_WRITTEN = "element_at(array('../wiki/x.md#top', './y.md', '../../z.md', '/abs.md', 'a/../b%20c+d.md'), CAST(doc_id % 5 AS int) + 1)"


@query("md_target", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'wiki/x.md' WHEN 1 THEN layer || '/y.md' WHEN 4 THEN layer || '/b c+d.md' END AS path FROM v_notes")
def md_target(v: Views) -> DataFrame:
    return v["v_notes"].select("doc_id", markdown.relative_path(F.concat("layer", F.lit("/n.md")), F.expr(_WRITTEN)).alias("path"))


@query("budget_sections", f"SELECT doc_id, (CASE WHEN n <= 360 THEN 3 WHEN a - 1 > 360 THEN 0 WHEN b - 1 > 360 THEN 1 ELSE 2 END)::int AS kept, 3::int AS total, n > 360 AS cut FROM ({_CUTS})")
def budget_sections(v: Views) -> DataFrame:
    return v["v_md"].select("doc_id", "md", markdown.budgeted("md", F.lit(90)).alias("b")).select("doc_id", "b.kept", "b.total", (F.col("b.text") != F.col("md")).alias("cut"))


@query("parse_errors", "SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'key title stands twice' WHEN 2 THEN 'tab in a header' WHEN 3 THEN 'no header' ELSE 'flow values aren''t part of a header' END AS error, (CASE doc_id % 5 WHEN 3 THEN 1 ELSE 5 + doc_id % 3 END)::int AS line FROM documents WHERE doc_id % 5 <> 0")
def parse_errors(v: Views) -> DataFrame:
    rows = v["v_headers"].select("doc_id", frontmatter.parsed_column("file").alias("p"))
    return rows.where("p.error IS NOT NULL").select("doc_id", "p.error", "p.line")


@query("header_fields", "SELECT doc_id, 'Note ' || doc_id AS title, lang AS tag, doc_id::varchar AS rank, (CASE doc_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'True' WHEN 2 THEN '~' END) AS flag, 'Body ' || doc_id || chr(10) || text AS body FROM documents WHERE doc_id % 5 = 0")
def header_fields(v: Views) -> DataFrame:
    rows = v["v_headers"].select("doc_id", frontmatter.parsed_column("file").alias("p")).where("p.error IS NULL")
    field = lambda path: F.get_json_object("p.fields", path)
    return rows.select("doc_id", field("$.title").alias("title"), field("$.tags[0]").alias("tag"), field("$.rank").alias("rank"), field("$.flag").alias("flag"), "p.body")


# ------------------------------------------------------------------ moves

#: The resolver's index again, over the names after the move.
_MOVED = "CASE WHEN cid LIKE 'wiki/%' AND cid LIKE '%5' THEN 'projects/moved-' || substr(cid, 6) ELSE cid END"
_AFTER = f"""c2 AS (SELECT cid AS old, x AS cid, CASE WHEN x LIKE 'wiki/%' THEN 0 WHEN x LIKE 'archive/%' THEN 2 ELSE 1 END AS prio, string_split(x, '/') AS p FROM (SELECT DISTINCT cid, {_MOVED} AS x FROM v_names)),
n2 AS (SELECT 'exact' AS kind, cid AS name, cid, prio FROM c2 UNION ALL SELECT 'exact', substr(cid, 6), cid, prio FROM c2 WHERE prio = 0
  UNION ALL SELECT 'suffix', array_to_string(p[2:], '/'), cid, prio FROM c2 WHERE len(p) >= 3 UNION ALL SELECT 'stem', p[-1], cid, prio FROM c2),
i2 AS (SELECT kind, name, cid FROM (SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY prio, cid) AS k FROM n2) x WHERE k = 1)"""
_FOUND = "coalesce((SELECT cid FROM {i} WHERE kind = 'exact' AND name = q.name), (SELECT cid FROM {i} WHERE kind = 'suffix' AND name = q.name), CASE WHEN instr(q.name, '/') = 0 THEN (SELECT cid FROM {i} WHERE kind = 'stem' AND name = q.name) END)"


@query(
    "move_plan",
    _INDEX
    + f""", {_AFTER}, r AS (SELECT DISTINCT v.cid AS source, q.probe AS target_raw, {_FOUND.format(i="i")} AS was, {_FOUND.format(i="i2")} AS will FROM q JOIN v_names v ON v.doc_id = q.doc_id)
    SELECT s.cid AS source_cid, target_raw, was, t.cid AS expected, will, CASE WHEN was IS NULL THEN 'newly_resolved' WHEN was <> t.cid THEN 'rewrite' ELSE 'blocked' END AS action
    FROM r JOIN c2 s ON s.old = r.source LEFT JOIN c2 t ON t.old = r.was WHERE will IS DISTINCT FROM t.cid""",
)
def move_plan(v: Views) -> DataFrame:
    n = v["v_names"]
    cids = n.select("cid").distinct()
    moves = cids.where("cid LIKE 'wiki/%' AND cid LIKE '%5'").select("cid", F.expr("'projects/moved-' || substr(cid, 6)").alias("new_cid"))
    return move.plan(n.select(F.col("cid").alias("source_cid"), F.col("probe").alias("target_raw")), cids, moves)


#: Notes of the wiki go into a folder; archived ones take names that links to others use.
_GOES = "CASE WHEN cid LIKE 'wiki/%' AND n % 3 = 0 THEN 'projects/moved/d' || n WHEN cid LIKE 'archive/%' AND n % 4 = 0 THEN 'wiki/d' || (n + 1) END"
_FOLDER = "string_split(regexp_replace({}, '/[^/]*$', ''), '/')"
_MOVES_SQL = (
    _INDEX.split("q AS (")[0].replace("v_names", "v_before WHERE layer <> 'raw'")
    + _AFTER.replace(f"SELECT DISTINCT cid, {_MOVED} AS x FROM v_names", f"SELECT DISTINCT cid, coalesce({_GOES}, cid) AS x FROM v_before WHERE layer <> 'raw'")
    + f""", q AS (
  SELECT b.cid AS source, s.cid AS goes_to, 0 AS start, 10 AS "end", 'wiki' AS kind, by_name AS target FROM v_before b JOIN c2 s ON s.old = b.cid
  UNION ALL SELECT b.cid, s.cid, 20, 40, 'markdown', by_path FROM v_before b JOIN c2 s ON s.old = b.cid
  UNION ALL SELECT b.cid, s.cid, 24, 30, 'wiki', 'd' || (n + 2) FROM v_before b JOIN c2 s ON s.old = b.cid
), w0 AS (SELECT q.*, q.target AS name, {_FOUND.format(i='i')} AS was, {_FOUND.format(i='i2')} AS will FROM (SELECT *, target AS name FROM q) q WHERE kind = 'wiki'),
w AS (SELECT w0.* EXCLUDE (name), t.cid AS expected, regexp_replace(t.cid, '^wiki/', '') AS plain FROM w0 LEFT JOIN c2 t ON t.old = was),
wiki AS (SELECT source, start, "end", kind, target, was, expected, will, CASE WHEN will IS DISTINCT FROM expected THEN CASE WHEN was IS NULL THEN 'newly_resolved' WHEN was <> expected THEN CASE WHEN (SELECT cid FROM i2 WHERE i2.kind = 'exact' AND name = plain) IS NOT DISTINCT FROM expected THEN 'rewrite' ELSE 'blocked' END ELSE 'blocked' END
  WHEN was <> expected AND target IN (was, regexp_replace(was, '^wiki/', '')) AND target NOT IN (expected, plain) THEN 'fragile' END AS action, CASE WHEN will IS DISTINCT FROM expected AND was <> expected THEN plain END AS text FROM w),
p0 AS (SELECT *, array_to_string({_FOLDER.format('source')}[:-2], '/') AS up, array_to_string({_FOLDER.format('goes_to')}[:-2], '/') AS up2, {_FOLDER.format('goes_to')} AS f FROM q WHERE kind <> 'wiki'),
p1 AS (SELECT *, CASE WHEN up = '' THEN '' ELSE up || '/' END || target[4:] AS was, CASE WHEN up2 = '' THEN '' ELSE up2 || '/' END || target[4:] AS will FROM p0),
p2 AS (SELECT p1.*, coalesce(t.cid || '.md', was) AS expected, t.cid IS NOT NULL AS there, EXISTS (SELECT 1 FROM c2 x WHERE x.old <> x.cid AND x.cid || '.md' = was) AS comes FROM p1 LEFT JOIN c2 t ON t.old || '.md' = was),
p3 AS (SELECT *, string_split(expected, '/') AS st FROM p2),
p4 AS (SELECT *, len(list_filter(range(1, least(len(f), len(st) - 1) + 1), lambda k: f[1:k] = st[1:k])) AS common FROM p3),
paths AS (SELECT source, start, "end", kind, target, was, expected, will, CASE WHEN CASE WHEN goes_to <> source THEN will <> expected ELSE expected <> was END THEN 'rewrite' WHEN goes_to = source AND NOT there AND comes THEN 'newly_resolved' END AS action, repeat('../', len(f) - common) || array_to_string(st[common + 1:], '/') AS text FROM p4),
planned AS (SELECT * FROM wiki WHERE action IS NOT NULL AND NOT (start = 24 AND text IS NOT NULL AND source IN (SELECT source FROM paths WHERE action = 'rewrite')) UNION ALL SELECT * REPLACE (CASE WHEN action = 'rewrite' THEN text END AS text) FROM paths WHERE action IS NOT NULL)"""
)


def planned(v: Views) -> DataFrame:
    """A plan over the links of `v_before`: one by name, and a path with a name inside its text."""
    notes = v["v_before"].where("layer <> 'raw'")
    span = lambda a, b, kind, target: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(kind).alias("kind"), target.alias("target"))
    each = F.array(span(0, 10, "wiki", F.col("by_name")), span(20, 40, "markdown", F.col("by_path")), span(24, 30, "wiki", F.concat(F.lit("d"), (F.col("n") + 2).cast("string"))))
    spans = notes.select(F.col("cid").alias("source_cid"), F.inline(each)).withColumns({"embed": F.lit(False), "angle": F.lit(False)})
    moves = notes.select("cid", F.expr(_GOES).alias("new_cid")).where("new_cid IS NOT NULL")
    return move.plan_spans(spans, notes.select("cid"), moves)


@query("move_spans", _MOVES_SQL + ' SELECT source AS source_cid, start, "end", kind, target, was, expected, will, action, text FROM planned')
def move_spans(v: Views) -> DataFrame:
    return planned(v)


@query("move_warnings", _MOVES_SQL + """, links AS (SELECT DISTINCT expected AS cid, source || '.md: [[' || target || ']]' AS link FROM planned WHERE action = 'fragile') SELECT cid, array_to_string(list_sort(list(link))[:3], '; ') AS first, count(*)::bigint AS total FROM links GROUP BY 1""")
def move_warnings(v: Views) -> DataFrame:
    return move.fragile_warnings(planned(v)).withColumn("first", F.array_join("first", "; "))


_ASK = "CASE doc_id % 7 WHEN 0 THEN '/abs/' || stem WHEN 1 THEN upper(rel_path) WHEN 2 THEN '[[' || stem || '|shown]]' WHEN 3 THEN lang || '-note#part' WHEN 4 THEN './' || rel_path WHEN 5 THEN '[[none/' || stem || ']]' ELSE layer || chr(92) || stem END"
_KNOWN = "CASE WHEN doc_id % 2 = 0 THEN cid ELSE layer || '/' || stem || '/' || lang || '-note' END"
_TARGETS_SQL = rf"""WITH asked AS (SELECT DISTINCT {_ASK} AS target FROM v_notes JOIN documents USING (doc_id) WHERE layer <> 'raw'),
c AS (SELECT DISTINCT {_KNOWN} AS cid FROM v_notes JOIN documents USING (doc_id) WHERE layer <> 'raw'),
a AS (SELECT target, starts_with(target, '/') AS bad, regexp_replace(regexp_replace(replace(target, chr(92), '/'), '^[.]/', ''), '[.][mM][dD]$', '') AS path FROM asked),
b AS (SELECT *, regexp_replace(regexp_replace(path, '^\[\[|\]\]$', '', 'g'), '[|#].*$', '') AS name FROM a),
n AS (SELECT cid, cid AS name, 0 AS pri FROM c UNION ALL SELECT cid, substr(cid, 6), 0 FROM c WHERE cid LIKE 'wiki/%'),
e AS (SELECT name, min(cid) AS cid FROM (SELECT n.*, CASE WHEN cid LIKE 'wiki/%' THEN 0 WHEN cid LIKE 'archive/%' THEN 2 ELSE 1 END AS k FROM n) x WHERE (name, k) IN (SELECT (name, min(CASE WHEN cid LIKE 'wiki/%' THEN 0 WHEN cid LIKE 'archive/%' THEN 2 ELSE 1 END)) FROM n GROUP BY name) GROUP BY name),
o AS (SELECT target, b.name, c.cid FROM b JOIN c ON CASE WHEN contains(b.name, '/') THEN ends_with(c.cid, '/' || b.name) ELSE string_split(c.cid, '/')[-1] = b.name END WHERE NOT bad AND b.name NOT IN (SELECT name FROM e)),
hits AS (SELECT target, cid, 0 AS rule FROM b JOIN c ON path = cid WHERE NOT bad UNION SELECT target, cid, 1 FROM b JOIN c ON lower(path) = lower(cid) WHERE NOT bad
  UNION SELECT target, e.cid, 2 FROM b JOIN e USING (name) WHERE NOT bad UNION SELECT target, cid, 2 FROM o WHERE cid NOT LIKE 'archive/%' OR name NOT IN (SELECT name FROM o WHERE cid NOT LIKE 'archive/%')),
best AS (SELECT * FROM hits WHERE (target, rule) IN (SELECT (target, min(rule)) FROM hits GROUP BY target)),
g AS (SELECT target, list_sort(list(cid)) AS cids, count(*) AS total FROM best GROUP BY target)
SELECT target, CASE WHEN total = 1 THEN cids[1] END AS cid, CASE WHEN bad THEN 'invalid' WHEN total IS NULL THEN 'not_found' WHEN total > 1 THEN 'ambiguous' END AS error, CASE WHEN total > 1 THEN array_to_string(cids[:20], ' ') END AS candidates, coalesce(total, 0)::bigint AS total FROM b LEFT JOIN g USING (target)"""


@query("targets_resolve", _TARGETS_SQL)
def targets_resolve(v: Views) -> DataFrame:
    """Targets of every fault and form, against notes of which a third share a name."""
    rows = v["v_notes"].where("layer <> 'raw'").join(v["documents"].select("doc_id", "lang"), "doc_id")
    found = graph.resolve_targets(rows.select(F.expr(_ASK).alias("target")), rows.select(F.expr(_KNOWN).alias("cid")))
    return found.withColumn("candidates", F.array_join("candidates", " "))


_MADE = "SELECT DISTINCT 'wiki/n' || (doc_id % 50) AS cid FROM v_names"
_NEW = _AFTER.split("n2 AS")[1].replace("c2", "c3").replace("i2 AS", "i3 AS").replace("FROM n2", "FROM n3")


@query(
    "scaffold_takeover",
    _INDEX
    + f""", c3 AS (SELECT cid, CASE WHEN cid LIKE 'wiki/%' THEN 0 WHEN cid LIKE 'archive/%' THEN 2 ELSE 1 END AS prio, string_split(cid, '/') AS p FROM (SELECT cid FROM v_names UNION {_MADE}) u),
    n3 AS {_NEW}, r AS (SELECT DISTINCT q.probe AS target_raw, {_FOUND.format(i="i")} AS was, {_FOUND.format(i="i3")} AS will FROM q)
    SELECT target_raw, was, will FROM r WHERE was IS NOT NULL AND will IS DISTINCT FROM was""",
)
def scaffold_takeover(v: Views) -> DataFrame:
    n = v["v_names"]
    created = n.select(F.concat(F.lit("wiki/n"), (F.col("doc_id") % 50).cast("string")).alias("cid")).distinct()
    return move.takeovers(n.select(F.col("probe").alias("target_raw")), n.select("cid").distinct(), created)


# ------------------------------------------------------------------ ingest and audit


@query(
    "audit_mismatch",
    """WITH f AS (SELECT rel_path, CASE doc_id % 7 WHEN 3 THEN 4 WHEN 2 THEN 4 WHEN 1 THEN 4 WHEN 4 THEN 5 END AS line, doc_id % 7 AS k FROM v_files WHERE doc_id % 5 <> 4)
    SELECT 'PROVENANCE_MISMATCH' AS code, f.rel_path, f.line::int AS line, 'human:ann' AS actor, coalesce(b.commit, '') AS commit,
    CASE k WHEN 3 THEN '''human:ann'' attestation has no history; commit the file' WHEN 2 THEN '''human:ann'' attestation isn''t committed yet' WHEN 1 THEN 'author ''eve@x.org'' of the ''human:ann'' attestation isn''t one of the actor''s identities' ELSE 'author ''eve@x.org'' of the ''human:ann'' attestation (its line 5) isn''t one of the actor''s identities' END AS message
    FROM f LEFT JOIN v_blame b ON b.rel_path = f.rel_path AND b.line = f.line WHERE k IN (1, 2, 3, 4)""",
)
def audit_mismatch(v: Views) -> DataFrame:
    people = v.spark.createDataFrame([("human:ann", "ann@x.org")], "actor string, email string")
    return audit.audit(audit.entries(v["v_files"].select("rel_path", "text")), v["v_blame"], people)


@query(
    "notes_ingest",
    r"""SELECT left(n.rel_path, length(n.rel_path) - 3) AS cid, n.rel_path, n.layer, n.stem, CASE WHEN doc_id % 5 = 0 THEN 'Note ' || doc_id END AS title, CASE WHEN doc_id % 5 = 0 THEN lang ELSE '' END AS tags, doc_id % 5 <> 0 AS broken, 'unverified' AS trust_tier,
    'sha256:' || sha256(regexp_replace(regexp_replace(regexp_replace(CASE WHEN doc_id % 5 = 3 THEN file ELSE regexp_extract(file, '(?s)\n---\n(.*)$', 1) END, '\r\n?', chr(10), 'g'), '[ \t\r\f\v]+(\n|\z)', '\1', 'g'), '\A\n+|\n+\z', '', 'g')) AS body_hash
    FROM v_headers JOIN v_notes n USING (doc_id) JOIN documents USING (doc_id) WHERE n.layer <> 'raw'""",
)
def notes_ingest(v: Views) -> DataFrame:
    files = v["v_headers"].join(v["v_notes"].where("layer <> 'raw'").select("doc_id", "rel_path"), "doc_id").select("rel_path", F.col("file").alias("text"), F.lit(0).cast("long").alias("file_size"), F.lit(0.0).alias("mtime"))
    return ingest.notes(files).select("cid", "rel_path", "layer", "stem", "title", "tags", F.col("parse_error").isNotNull().alias("broken"), "trust_tier", "body_hash")


_RAW_FILE = "'raw/' || p_partkey || '/' || CASE p_partkey % 4 WHEN 0 THEN 'a.TXT' WHEN 1 THEN 'b.pdf' WHEN 2 THEN '.hidden.md' ELSE 'c.md' END"


@query("raw_ingest", f"SELECT rel_path, rel_path AS cid, 'raw' AS layer, string_split(rel_path, '/')[-1] AS title, CASE WHEN rel_path LIKE '%.pdf' THEN '' ELSE p_name END AS body, sha256(p_name) AS file_hash FROM (SELECT p_name, {_RAW_FILE} AS rel_path FROM part) x WHERE rel_path NOT LIKE '%/.%'")
def raw_ingest(v: Views) -> DataFrame:
    files = v["part"].select(F.expr(_RAW_FILE).alias("rel_path"), F.col("p_name").cast("binary").alias("content"), F.length("p_name").cast("long").alias("file_size"), F.lit(0.0).alias("mtime"))
    return ingest.raw(files, list(vault.TEXT_SUFFIXES)).select("rel_path", "cid", "layer", "title", "body", "file_hash")
