"""Views of the star-schema and corpus tables as notes, links and sources, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.markdown import parts
from marginalia.functions.scalar import body_hash, trust_tier
from marginalia.functions.text import camel_subwords
from marginalia.operators import incremental
from marginalia.operators.search import Index, build, load
from marginalia.sources.shared import shared_dir
from marginalia.sources.snapshots import Snapshots

NOTES = """
SELECT doc_id, layer, stem, layer || '/' || CASE WHEN layer = 'wiki' AND doc_id % 31 = 0 THEN 'deep/' ELSE '' END || stem || CASE WHEN layer = 'raw' THEN '.txt' ELSE '' END AS cid,
  layer || '/' || CASE WHEN layer = 'wiki' AND doc_id % 31 = 0 THEN 'deep/' ELSE '' END || stem || CASE WHEN layer = 'raw' THEN '.txt' ELSE '.md' END AS rel_path,
  CASE WHEN doc_id % 37 = 0 THEN '' ELSE substr(split_part(text, chr(10), 1), 1, 60) END AS title,
  nullif(split_part(text, chr(10), 2), '') AS description,
  CASE WHEN doc_id % 17 = 0 THEN 'moc' WHEN doc_id % 4 = 0 THEN 'concept' WHEN doc_id % 4 = 1 THEN 'entity' WHEN doc_id % 4 = 2 THEN 'guide' ELSE 'synthesis' END AS type,
  CASE WHEN doc_id % 43 = 0 THEN 'bogus' WHEN doc_id % 7 = 0 THEN 'active' WHEN doc_id % 7 = 1 THEN 'evergreen' WHEN doc_id % 7 = 2 THEN 'draft' WHEN doc_id % 7 = 3 THEN 'completed' WHEN doc_id % 7 = 4 THEN 'deprecated' WHEN doc_id % 7 = 5 THEN 'abandoned' END AS status,
  lang || coalesce(' q' || quality, '') AS tags,
  CASE WHEN doc_id % 23 = 0 THEN 'Bad Tag' WHEN doc_id % 29 = 0 THEN 'Not_Canonical' ELSE lang END AS tag,
  CASE doc_id % 6 WHEN 0 THEN 'CrashLoopBackOff' WHEN 1 THEN 'FP8TensorCore n' || doc_id WHEN 2 THEN 'crash loop back off' END AS alias,
  text AS body, CASE WHEN doc_id % 41 = 0 THEN 'line 1: no header' END AS parse_error,
  CASE WHEN quality IS NULL THEN NULL WHEN doc_id % 47 = 0 THEN 'nobody' WHEN quality = 1 THEN 'human:ann' ELSE 'agent:bot' END AS ver_by,
  toxic AS ver_stale, CASE WHEN doc_id % 19 = 0 THEN '2024-13-01T00:00:00Z' ELSE '2024-03-01T10:00:00Z' END AS ver_at
FROM (SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic, 'd' || d.doc_id AS stem,
        CASE try_cast(substr(d.source, 4) AS int) % 5 WHEN 0 THEN 'wiki' WHEN 1 THEN 'customers' WHEN 2 THEN 'projects' WHEN 3 THEN 'archive' ELSE 'raw' END AS layer
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) base
"""

#: Order to part, supplier and customer, and those to their places; large parts are dead targets.
LINKS = """
SELECT 'order/' || l_orderkey AS source_cid, 'part/' || l_partkey AS target_raw, CASE WHEN p_size <= 45 THEN 'part/' || l_partkey END AS target_cid, count(*) AS occurrences
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_partkey, p_size
UNION ALL SELECT 'order/' || l_orderkey, 'supplier/' || l_suppkey, 'supplier/' || l_suppkey, count(*) FROM lineitem GROUP BY l_orderkey, l_suppkey
UNION ALL SELECT 'order/' || o_orderkey, 'customer/' || o_custkey, 'customer/' || o_custkey, 1 FROM orders
UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'nation/' || c_nationkey, 1 FROM customer
UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'nation/' || s_nationkey, 1 FROM supplier
UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey, 'region/' || n_regionkey, 1 FROM nation
"""

PART_LINKS = "SELECT source_cid, target_raw, target_cid, occurrences FROM v_links WHERE source_cid LIKE 'order/%' AND target_raw LIKE 'part/%'"

HUB_LINKS = "SELECT 'supplier/' || l_suppkey AS source_cid, 'part/' || l_partkey AS target_raw, 'part/' || l_partkey AS target_cid, count(*) AS occurrences FROM lineitem GROUP BY l_suppkey, l_partkey"

#: Citations: every line of an order cites its part; parts of one size are misspelled.
SOURCES = """
SELECT DISTINCT 'order/' || l_orderkey AS source_cid, CASE WHEN p_size = 13 THEN 'raw/lost-' || l_partkey ELSE 'raw/part-' || l_partkey END AS raw_path,
  CASE WHEN p_size = 13 THEN NULL ELSE 'raw/part-' || l_partkey END AS resolved_path
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

#: Parts as raw files.
RAW = "SELECT 'raw/part-' || p_partkey AS rel_path, p_partkey FROM part"

#: Links between the notes made of documents, for gates and worklists: to a neighbour, to a stem, and to nothing.
NOTE_LINKS = """
SELECT a.cid AS source_cid, b.cid AS target_raw, CASE WHEN b.parse_error IS NULL THEN b.cid END AS target_cid, 1 AS occurrences
  FROM v_notes a JOIN v_notes b ON b.doc_id = a.doc_id + 3 AND a.tags LIKE 'en%'
UNION ALL SELECT cid, 'nowhere/' || stem, NULL, 1 FROM v_notes WHERE tags LIKE 'es%'
UNION ALL SELECT a.cid, b.cid, CASE WHEN b.parse_error IS NULL THEN b.cid END, 1 FROM v_notes a JOIN v_notes b ON b.doc_id = a.doc_id * 2 WHERE a.type = 'moc'
"""

NOTE_SOURCES = """
SELECT cid AS source_cid, CASE WHEN doc_id % 9 = 0 THEN 'raw/none-' || doc_id ELSE 'raw/d' || (doc_id - doc_id % 5 + 4) || '.txt' END AS raw_path,
  CASE WHEN doc_id % 9 <> 0 AND EXISTS_RAW THEN 'raw/d' || (doc_id - doc_id % 5 + 4) || '.txt' END AS resolved_path
FROM (SELECT n.*, r.cid AS raw_cid FROM v_notes n LEFT JOIN v_notes r ON r.layer = 'raw' AND r.cid = 'raw/d' || (n.doc_id - n.doc_id % 5 + 4) || '.txt') x
WHERE layer <> 'raw' AND tags NOT LIKE 'fr%'
""".replace("EXISTS_RAW", "raw_cid IS NOT NULL")

#: Names with several segments and many collisions of stems.
NAMES = """
SELECT doc_id, layer || '/' || type || '/n' || (doc_id % 50) AS cid, CASE doc_id % 4 WHEN 0 THEN 'n' || (doc_id % 50) WHEN 1 THEN type || '/n' || (doc_id % 50) || '.md' WHEN 2 THEN '/' || layer || '/' || type || '/n' || (doc_id % 50) ELSE 'none/n' || (doc_id % 50) END AS probe FROM v_notes WHERE layer <> 'raw'
"""

LISTING_OLD = "SELECT 'wiki/o' || o_orderkey || '.md' AS rel_path, CAST(o_orderkey AS double) AS mtime, CAST(length(o_orderpriority) AS bigint) AS file_size FROM orders"
LISTING_NEW = """
SELECT 'wiki/o' || o_orderkey || '.md' AS rel_path, CAST(o_orderkey AS double) AS mtime, CAST(length(o_orderpriority) + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS bigint) AS file_size FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'wiki/new' || o_orderkey || '.md', 0.5, CAST(7 AS bigint) FROM orders WHERE o_orderstatus = 'P'
"""

#: Notes as Markdown, with fences, inline code, math, sections and links of each kind, and the document's whole text, in which a common word of its language is a link; a text with dollars has none, as these enclose formulas.
MD = """
SELECT doc_id, cid, layer, stem, rel_path, CASE WHEN doc_id % 4 = 0 THEN 'Section 9' ELSE 'section-' || ((doc_id + 1) % 3) END AS wanted,
  '# Note ' || doc_id || chr(10) || 'See [[d' || (doc_id + 1) || '#' || CASE WHEN doc_id % 4 = 0 THEN 'Section 9' ELSE 'section-' || ((doc_id + 1) % 3) END || '|next]], `[[code]]`, [[d' || (doc_id + 1) || '#' || CASE WHEN doc_id % 4 = 0 THEN 'Section 9' ELSE 'section-' || ((doc_id + 1) % 3) END || ']].' || chr(10)
  || '```' || chr(10) || '## Fenced' || chr(10) || '[[fenced]]' || chr(10) || '```' || chr(10) || '## Section ' || (doc_id % 3) || ' ##' || chr(10)
  || 'A [file](../wiki/d' || (doc_id % 7) || '.md#Top), ![[chart.png]], [site](https://example.org/x.md) and $[[math]]$.' || chr(10) || '### Deep `x`' || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN 'Even [source](../raw/d' || (doc_id + 1) || '.txt).' ELSE 'Odd.' END || chr(10) || '## Last' || chr(10) || repeat('word ', CAST(doc_id % 50 AS int)) || chr(10) || CASE WHEN contains(body, '$') THEN body ELSE replace(body, ' ' || common || ' ', ' [[' || common || ']] ') END || chr(10) AS md,
  common, CASE WHEN contains(body, '$') THEN 0 ELSE (length(body) - length(replace(body, ' ' || common || ' ', ''))) / (length(common) + 2) END AS links_in_text
FROM (SELECT *, CASE WHEN tags LIKE 'en%' THEN 'the' WHEN tags LIKE 'de%' THEN 'der' ELSE 'de' END AS common FROM v_notes) named
"""

#: Notes' headers before the documents' whole texts: one in five well formed, the others each with its own fault, on different lines.
HEADERS = """
SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN '' ELSE '---' || chr(10) || repeat('# a comment' || chr(10), CAST(doc_id % 3 AS int)) || 'title: "Note ' || doc_id || '" # comment' || chr(10) || 'tags:' || chr(10) || '  - ' || lang || chr(10)
  || CASE doc_id % 5 WHEN 1 THEN 'title: again' WHEN 2 THEN chr(9) || 'x: 1' WHEN 4 THEN 'x: [1, 2]' ELSE 'rank: ' || doc_id || chr(10) || 'flag: ' || CASE doc_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'True' WHEN 2 THEN '~' ELSE 'null' END END || chr(10) || '---' || chr(10) END || 'Body ' || doc_id || chr(10) || text AS file
FROM documents
"""

#: Notes as files with an attestation each, by a human or an agent.
FILES = """
SELECT doc_id, rel_path, '---' || chr(10) || 'title: Note ' || doc_id || chr(10) || 'verified:' || chr(10) || '  - by: ' || CASE WHEN doc_id % 5 = 4 THEN 'agent:bot' ELSE 'human:ann' END || chr(10)
  || '    at: 2024-03-01T10:00:00Z' || chr(10) || '---' || chr(10) || body AS text FROM v_notes WHERE layer <> 'raw'
"""

#: Who is blamed for the attestations' lines: the actor, another, nobody yet, no history; the second line of some is another's.
BLAME = """
SELECT rel_path, CAST(4 AS int) AS line, CASE WHEN doc_id % 7 = 2 THEN repeat('0', 40) ELSE 'c' || rel_path END AS commit, CASE WHEN doc_id % 7 = 1 THEN 'eve@x.org' ELSE 'ann@x.org' END AS email FROM v_files WHERE doc_id % 7 <> 3
UNION ALL SELECT rel_path, CAST(5 AS int), 'd' || rel_path, CASE WHEN doc_id % 7 = 4 THEN 'eve@x.org' ELSE 'ann@x.org' END FROM v_files WHERE doc_id % 7 <> 3
"""

#: A collection before and after changes: notes that go, that are written anew, that break, that are read under other settings, and new ones made of parts.
BEFORE = """
SELECT doc_id AS n, rel_path, cid, layer, title, description, body, tags, alias AS aliases, '' AS subwords, type, status, parse_error, CAST(1 AS double) AS mtime, CAST(length(body) AS bigint) AS file_size, 'a' AS settings,
  CASE doc_id % 5 WHEN 0 THEN 'd' || (doc_id + 1) WHEN 1 THEN 'deep/d' || (doc_id + 30) WHEN 2 THEN 'p' || doc_id WHEN 3 THEN layer || '/d' || (doc_id + 5) ELSE 'none/d' || doc_id END AS by_name,
  CASE WHEN doc_id % 2 = 0 THEN '../' || layer || '/d' || (doc_id + 2) || '.md' ELSE '../projects/p' || doc_id || '.md' END AS by_path
FROM v_notes
"""
AFTER = """
SELECT n, rel_path, cid, layer, CASE WHEN status = 'draft' THEN title || ' thsh' ELSE title END AS title, description, body, tags, aliases, subwords, type, status, CASE WHEN status = 'completed' AND type = 'concept' THEN 'line 2' ELSE parse_error END AS parse_error,
  CASE WHEN status = 'draft' OR (status = 'completed' AND type = 'concept') THEN CAST(2 AS double) ELSE mtime END AS mtime, file_size, CASE WHEN type = 'guide' THEN 'b' ELSE settings END AS settings, by_name, by_path
FROM v_before WHERE coalesce(status, '') <> 'abandoned'
UNION ALL SELECT p_partkey, 'projects/p' || p_partkey || '.md', 'projects/p' || p_partkey, 'projects', p_name, NULL, p_type, p_brand, NULL, '', 'guide', 'active', NULL, CAST(1 AS double), CAST(7 AS bigint), 'a', 'd' || p_partkey, '../wiki/d' || p_partkey || '.md' FROM part
"""

VIEWS = {"v_before": BEFORE, "v_after": AFTER, "v_files": FILES, "v_blame": BLAME, "v_md": MD, "v_headers": HEADERS, "v_notes": NOTES, "v_links": LINKS, "v_part_links": PART_LINKS, "v_hub_links": HUB_LINKS, "v_sources": SOURCES, "v_raw": RAW, "v_note_links": NOTE_LINKS, "v_note_sources": NOTE_SOURCES, "v_names": NAMES, "v_old": LISTING_OLD, "v_new": LISTING_NEW}
#: Views that several operators of one query read, with the tables that they are made of: written once, as notes are when they are read in.
WRITTEN = {v: ("documents", "labels") for v in ("v_note_links", "v_note_sources")}
TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels")


class Views:
    """The views of one folder of tables, as frames of one session."""

    def __init__(self, spark: SparkSession, sf_dir: str, inside: bool = False):
        """inside: nothing is written, for the plan that writes a view."""
        self.spark, self.sf_dir, self.inside = spark, sf_dir, inside
        self.made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in WRITTEN and not self.inside:
                self.made[name] = self._written(name, WRITTEN[name], lambda: Views(self.spark, self.sf_dir, True)[name])
            elif name in VIEWS:
                import re

                text = VIEWS[name]
                used = {w for w in re.findall(r"\b\w+\b", text) if w in VIEWS or w in TABLES}
                for w in used:
                    text = re.sub(rf"\b(FROM|JOIN) {w}\b", rf"\1 {{{w}}}", text)
                self.made[name] = self.spark.sql(text, **{w: self[w] for w in used})
            else:
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]

    @property
    def notes(self) -> DataFrame:
        """v_notes with body_hash, verified, trust_tier and tag_list, as they are when notes are read in: written once."""
        if "notes" not in self.made:
            self.made["notes"] = self._written("notes", ("documents", "labels"), self._notes)
        return self.made["notes"]

    @property
    def heads(self) -> DataFrame:
        """v_notes with what a header lists (alias_list, tag_list, generated): nothing is made of the body, so it is read as it lies, by the columns that a query names."""
        listed = F.when(F.col("doc_id") % 53 == 0, F.array(F.lit("two\nlines"))).when(F.col("alias").isNotNull(), F.array("alias")).otherwise(F.array().cast("array<string>"))
        at = F.expr("CASE WHEN doc_id % 59 = 0 THEN 'yesterday' ELSE '2024-02-29T00:00:00Z' END")
        return self["v_notes"].withColumns({"alias_list": listed, "generated": F.struct(F.lit("process:import").alias("by"), at.alias("at")), "tag_list": F.array("tag")})

    def _notes(self) -> DataFrame:
        rows = self.heads.withColumn("body_hash", body_hash(F.col("body")))
        of = F.when(F.col("ver_stale") == 1, F.lit("sha256:old")).otherwise(F.col("body_hash"))
        entry = F.struct(F.col("ver_by").alias("by"), F.col("ver_at").alias("at"), of.alias("of"))
        rows = rows.withColumn("verified", F.when(F.col("ver_by").isNotNull(), F.array(entry)))
        rows = rows.withColumns({"aliases": F.col("alias"), "subwords": F.array_join(camel_subwords(F.concat_ws(" ", "title", "description", "alias", "body")), " ")})
        return rows.withColumn("trust_tier", trust_tier(F.col("verified"), F.col("body_hash")))

    @property
    def parsed(self) -> DataFrame:
        """v_md's notes with their links and headings, each text read by the parser once, as when notes are read in."""
        rows = lambda: self["v_md"].withColumn("p", parts("md")).select("doc_id", "cid", "layer", "stem", "rel_path", "p.*")
        return self._written("parsed", ("documents", "labels"), rows)

    def _written(self, name: str, tables: tuple[str, ...], rows: Callable[[], DataFrame]) -> DataFrame:
        return self.spark.read.parquet(self._once(name, tables, lambda where: rows().write.parquet(where)))

    def _once(self, kind: str, tables: tuple[str, ...], make: Callable[[str], object]) -> str:
        """A folder of the shared one, made once for what the tables' files are now."""
        files = [f"{self.sf_dir}/{t}.parquet" for t in tables]
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files).select("path", "length", "modificationTime").collect()  # a table's files
        key = (kind, self.spark.sparkContext.applicationId, self.sf_dir, tuple(sorted((r.path, r.length, str(r.modificationTime)) for r in listed)))
        if key not in _BUILT:
            where = f"{shared_dir(self.spark)}/marginalia/{kind}-{uuid.uuid4().hex}"
            make(where)
            _BUILT[key] = where
        return _BUILT[key]

    @property
    def index(self) -> Index:
        """The search index over `notes`."""
        return load(self.spark, self._once("index", ("documents", "labels"), lambda where: build(self.notes, where)))

    @property
    def followed(self) -> Snapshots:
        """A store that was scanned with `v_before`, and again with `v_after`."""

        def links(notes: DataFrame) -> DataFrame:
            both = F.array(F.struct(F.lit("wiki").alias("kind"), F.col("by_name").alias("target")), F.struct(F.lit("markdown").alias("kind"), F.col("by_path").alias("target")))
            return notes.where("parse_error IS NULL AND layer <> 'raw'").select(F.col("cid").alias("source_cid"), F.inline(both))

        def make(where: str) -> None:
            store = Snapshots(self.spark, where)
            for name in ("v_before", "v_after"):
                incremental.scan(store, self[name], lambda paths, name=name: self[name].join(paths, "rel_path", "left_semi").drop("mtime", "file_size", "settings"), links)

        return Snapshots(self.spark, self._once("followed", ("documents", "labels", "part"), make))


_BUILT: dict[tuple, str] = {}

TIER = "CASE WHEN ver_by IS NULL THEN 'unverified' WHEN ver_by = 'nobody' OR ver_stale = 1 THEN 'stale-verified' WHEN ver_by = 'human:ann' THEN 'human-reviewed' ELSE 'machine-confirmed' END"



def _cut(where: str) -> str:
    """SQL: the word w, cut before the characters for which a condition holds; c is one, b and a stand before it, d and e after it."""
    for name, at in (("a", "i - 2"), ("b", "i - 1"), ("c", "i"), ("d", "i + 1"), ("e", "i + 2")):
        where = where.replace(f"<{name}>", f"w[{at}]")
    return f"string_split(array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND ({where}) THEN ' ' ELSE '' END || w[i]), ''), ' ')"


_HUMP = "(<b> BETWEEN 'a' AND 'z' OR <b> BETWEEN '0' AND '9') AND <c> BETWEEN 'A' AND 'Z'"
_SHORT = "<a> BETWEEN 'A' AND 'Z' AND <b> BETWEEN 'a' AND 'z' AND (<d> = '' OR (<d> BETWEEN 'A' AND 'Z' AND <e> BETWEEN 'a' AND 'z'))"
_ROW = "<b> BETWEEN 'A' AND 'Z' AND <c> BETWEEN 'A' AND 'Z' AND <d> BETWEEN 'a' AND 'z'"
_DIGITS = "((<b> BETWEEN 'a' AND 'z' OR <b> BETWEEN 'A' AND 'Z') AND <c> BETWEEN '0' AND '9') OR (<b> BETWEEN '0' AND '9' AND <c> BETWEEN 'a' AND 'z')"


def subwords_sql(text: str) -> str:
    """SQL for DuckDB: the sorted distinct subwords of a text."""
    halves, parts = _cut(_HUMP), _cut(f"({_HUMP} AND NOT ({_SHORT})) OR ({_ROW}) OR {_DIGITS}")
    many = lambda xs: f"CASE WHEN len({xs}) > 1 THEN {xs} ELSE [] END"
    pairs = "list_transform(range(1, len(p)), lambda i: p[i] || p[i + 1])"
    begins = "list_transform(range(3, len(p)), lambda i: array_to_string(p[1:i], ''))"
    each = f"flatten(list_transform([{parts}], lambda p: list_concat({many('p')}, {pairs}, {begins})))"
    words = f"list_filter(list_distinct(regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9]+')), lambda w: regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]'))"
    return f"list_sort(list_distinct(list_transform(flatten(list_transform({words}, lambda w: list_concat(flatten(list_transform([{halves}], lambda h: {many('h')})), {each}))), lambda s: lower(s))))"


SUBWORDS = subwords_sql("concat_ws(' ', title, description, alias, body)")


def with_views(sql: str) -> str:
    """A statement for DuckDB with the views it needs in front; `notes` is v_notes with trust_tier, aliases and subwords."""
    import re

    views = VIEWS | {"notes": f"SELECT *, {TIER} AS trust_tier, alias AS aliases, array_to_string({SUBWORDS}, ' ') AS subwords FROM v_notes"}
    needed: list[str] = []

    def need(text: str) -> None:
        for w in dict.fromkeys(re.findall(r"\b\w+\b", text)):
            if w in views and w not in needed:
                need(views[w])
                needed.append(w)

    need(sql)
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    body = sql.replace("WITH RECURSIVE", ",", 1) if recursive else re.sub(r"\A\s*WITH\b", ",", sql)
    joint = "" if body.lstrip().startswith(",") else "\n"
    return f"WITH {recursive}" + ",\n".join(f"{v} AS ({views[v]})" for v in needed) + joint + body if needed else sql
