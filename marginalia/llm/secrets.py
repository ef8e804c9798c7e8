"""Secret scans with corpus-wide ownership frequency, in DataFrame operations alone.

Spans come from the pieces between matches: a match starts where the pieces and
matches before it end.  Besides the base patterns, long mixed strings are
candidates.  All candidate values are hashed and counted over the whole corpus:
by the documents, the distinct repositories and the distinct owners that hold
them.  A value that is held widely is a copied example; one that a single owner
holds, in few repositories and few documents, looks live.  Candidates outside
the base patterns become spans (kind `owned`) if they look live; base spans stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, table

#: The base patterns, ASCII letters in either case spelled out.
NAMES = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
LEAD = NAMES + r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = LEAD + r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters and over; a shorter run has no longer match inside
HEX = r"[0-9a-f]{32,}"
LOOSE = r"[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "owned")
#: A value held by more owners, repositories or documents than these is a copied example.
LIVE_OWNERS, LIVE_REPOSITORIES, LIVE_DOCUMENTS = 1, 2, 5
#: Matches whose lengths are summed at a time, so that places cost little more than the matches.
RUN = 256

_SPAN = "array<struct<start: long, order: int, end: long, value: string>>"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)


def _spans(text: Column, pattern: str, order: int, keep, value=lambda m: m) -> Column:
    """Sorted structs of the leftmost matches for which `keep` holds."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # what precedes each match, from the last match's end; the last piece follows the last match
    paired = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, f: F.struct(F.length(b).cast("long").alias("gap"), F.length(f).cast("long").alias("size"), f.alias("found")))

    def placed(pairs: Column) -> Column:
        long = F.transform(pairs, lambda p: p["gap"] + p["size"])
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), lambda r: _sum(F.slice(pairs["gap"], r * RUN + 1, F.lit(RUN))) + _sum(F.slice(pairs["size"], r * RUN + 1, F.lit(RUN))))
        bases = _let(runs, lambda rs: F.transform(rs, lambda r, k: _sum(F.slice(rs, F.lit(1), k))))
        return _let(F.struct(long.alias("long"), bases.alias("bases")), lambda at: F.transform(pairs, lambda p, i: _let(at["bases"][F.floor(i / RUN).cast("int")] + _sum(F.slice(at["long"], F.floor(i / RUN).cast("int") * RUN + 1, i % RUN)) + p["gap"], lambda start: F.struct(start.alias("start"), F.lit(order).alias("order"), (start + p["size"]).alias("end"), p["found"].alias("value")))))

    kept = _let(paired, lambda pairs: F.transform(F.filter(placed(pairs), lambda s: keep(s["value"])), lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), value(s["value"]).alias("value"))))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(_SPAN))


def _joined(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kind, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, repository: str = "source", live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES, live_documents: int = LIVE_DOCUMENTS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, most_owners, most_repositories, most_documents for every row.

    Null texts count as empty; without a span, counts are 0 and spans is empty.
    The owner of a repository is what stands before its last slash, or the
    repository; a null one, or a table without that column, is an owner of its
    own.  Repeated rows each give a row and are documents each.  n_live and
    n_copied count the row's candidates by what the corpus says of their values;
    most_* are the largest counts of any of them, 0 without candidates.  An empty
    table gives no rows.  Only doc_id, text and the repository are read, so other
    columns may have any name.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda m: F.regexp_replace(m, F.lit("^" + LEAD), F.lit(""))
    assign = _spans(text, ASSIGN, 0, lambda m: F.length(bare(m)) >= 8, bare)
    access = _spans(text, ACCESS, 1, lambda m: F.lit(True))
    hexes = _spans(text, HEX, 2, lambda m: F.lit(True))
    loose = _spans(text, LOOSE, 3, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.regexp_extract_all(m, F.lit("."), F.lit(0)))) >= 10))
    repo = F.coalesce(F.col(repository).cast("string"), F.lit("")) if repository in docs.columns else F.lit("")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), repo.alias("repo"), assign.alias("assign"), access.alias("access"), hexes.alias("hex"), loose.alias("loose"))
    base = F.concat("assign", "access", "hex")
    free = F.filter("loose", lambda c: ~F.exists(base, lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"])))
    found = found.select("doc_id", "repo", F.monotonically_increasing_id().alias("row"), F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"), base.alias("base"), free.alias("loose"))
    found = materialize(found, "secrets")  # spans alone: text isn't carried further
    hash_of = lambda c: F.xxhash64(F.lower(c["value"]))
    every = F.concat("base", "loose")
    # a value counts once for a document; sums by repository come before the shuffle on values, so one that is everywhere is no hot group
    held = found.select("repo", F.explode(F.array_distinct(F.transform(every, hash_of))).alias("hash")).groupBy("hash", "repo").agg(F.count("*").alias("n")).withColumn("owner", F.regexp_replace("repo", "/[^/]*$", ""))
    owners = held.groupBy("hash", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"), F.sum("n").alias("documents"))
    candidates = found.select("row", F.explode(every).alias("c")).select("row", hash_of(F.col("c")).alias("hash"), "c")
    live = (F.col("owners") <= live_owners) & (F.col("repositories") <= live_repositories) & (F.col("documents") <= live_documents)
    judged = candidates.join(owners, "hash").withColumn("live", live)
    added = judged.groupBy("row").agg(F.collect_list(F.when(F.col("live") & (F.col("c.order") == 3), F.col("c"))).alias("owned"), F.count_if("live").alias("live"), F.count_if(~F.col("live")).alias("copied"), *[F.max(c).alias(f"most_{c}") for c in ("owners", "repositories", "documents")])
    whole = found.join(added, "row", "left")
    spans = F.concat("base", F.coalesce("owned", F.array().cast(_SPAN)))
    zero = F.lit(0).cast("long")
    return whole.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"), F.coalesce("live", zero).alias("n_live"), F.coalesce("copied", zero).alias("n_copied"), *[F.coalesce(c, zero).alias(c) for c in ("most_owners", "most_repositories", "most_documents")])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, each source as a repository.  See `scan`."""
    return scan(table(spark, sf_dir, "documents"))


def _matches_sql(order: int, pattern: str, keep: str, value: str = "m") -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT row_, {order} AS kind_, s, s + len(m) AS e, {value} AS v FROM (
  SELECT row_, f[i] AS m, list_sum(list_transform(b[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: len(x))), 0) AS s
  FROM (SELECT row_, b, f, unnest(range(1, len(f) + 1)) AS i FROM (SELECT row_, string_split_regex(t, '{quoted}') AS b, regexp_extract_all(t, '{quoted}') AS f FROM d) x) y) z WHERE {keep}"""


_LEAD = LEAD.replace("'", "''")
_BARE = f"regexp_replace(m, '^{_LEAD}', '')"
_LISTED = "string_agg(['assign', 'access', 'hex', 'owned'][kind_ + 1] || ':' || s::bigint || ':' || e::bigint, ',' ORDER BY s, kind_)"
#: The same over the table documents, for DuckDB.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS repo FROM documents),
base AS ({_matches_sql(0, ASSIGN, f"len({_BARE}) >= 8", _BARE)} UNION ALL {_matches_sql(1, ACCESS, "true")} UNION ALL {_matches_sql(2, HEX, "true")}),
loose AS (SELECT * FROM ({_matches_sql(3, LOOSE, "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND len(list_distinct(regexp_extract_all(m, '.'))) >= 10")}) l
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row_ = l.row_ AND l.s < b.e AND b.s < l.e)),
candidates AS (SELECT row_, kind_, s, e, lower(v) AS v FROM base UNION ALL SELECT row_, kind_, s, e, lower(v) FROM loose),
owners AS (SELECT v, count(DISTINCT regexp_replace(repo, '/[^/]*$', '')) AS owners, count(DISTINCT repo) AS repositories, count(DISTINCT row_) AS documents FROM candidates JOIN d USING (row_) GROUP BY v),
judged AS (SELECT c.*, owners, repositories, documents, owners <= {LIVE_OWNERS} AND repositories <= {LIVE_REPOSITORIES} AND documents <= {LIVE_DOCUMENTS} AS live FROM candidates c JOIN owners USING (v)),
summed AS (SELECT row_, count(*) FILTER (kind_ = 0) AS n_assign, count(*) FILTER (kind_ = 1) AS n_access, count(*) FILTER (kind_ = 2) AS n_hex,
  {_LISTED} FILTER (kind_ < 3) AS base, {_LISTED} FILTER (kind_ < 3 OR live) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied,
  max(owners) AS most_owners, max(repositories) AS most_repositories, max(documents) AS most_documents FROM judged GROUP BY row_)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories, coalesce(most_documents, 0) AS most_documents
FROM d LEFT JOIN summed USING (row_)
"""
