"""Quality gates.  Each gate is a frame of findings (code, severity, rel_path, message); all are unions of native plans."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.markdown import names_heading, relative_path, relative_to, spelled_path
from marginalia.functions.scalar import STATUSES, TAG, valid_actor, valid_timestamp
from marginalia.operators import graph, samples

ERROR, WARNING = "error", "warning"
REQUIRED = ("type", "title", "description", "status")


def finding(code: str, message: Column, severity: str = ERROR) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("rel_path"), message.alias("message"))


FINDING = "array<struct<code: string, severity: string, rel_path: string, message: string>>"


def _found(*when: tuple[Column, Column]) -> Column:
    """Findings whose condition holds, as an array."""
    return F.filter(F.array(*[F.when(c, f) for c, f in when]), lambda x: x.isNotNull())


def _of_each(items: Column | str, found: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(items, found))


def _rows(rows: DataFrame, *found: Column) -> DataFrame:
    """A row for each finding of arrays that may be null."""
    each = [F.coalesce(x.cast(FINDING), F.array().cast(FINDING)) for x in found]
    return rows.select(F.explode(F.concat(*each)).alias("f")).select("f.*")


def _each(rows: DataFrame, *when: tuple[Column, Column]) -> DataFrame:
    """Findings of a row: those whose condition holds."""
    return _rows(rows, _found(*when))


def parsed(notes: DataFrame) -> DataFrame:
    return notes.where("parse_error is null and layer != 'raw'")


def _unparseable() -> Column:
    return _found((F.col("parse_error").isNotNull(), finding("FRONTMATTER_UNPARSEABLE", F.col("parse_error"))))


def unparseable(notes: DataFrame) -> DataFrame:
    return _rows(notes.where("layer != 'raw'"), _unparseable())


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def _fields() -> Column:
    return _found(*[(_blank(c), finding("FIELD_MISSING", F.lit(f"Missing required field '{c}'"))) for c in REQUIRED])


def fields(notes: DataFrame) -> DataFrame:
    return _rows(parsed(notes), _fields())


def _with_types(rows: DataFrame, types: DataFrame | None) -> DataFrame:
    return rows.join(types.select("layer", F.col("allowed").alias("_allowed")), "layer", "left") if types is not None else rows.withColumn("_allowed", F.lit(None).cast("array<string>"))


def _enums() -> Column:
    bad_type = ~_blank("type") & F.col("_allowed").isNotNull() & ~F.array_contains("_allowed", F.col("type"))
    bad_status = ~_blank("status") & ~F.col("status").isin(*STATUSES)
    return _found((bad_type, finding("ENUM_INVALID", F.concat(F.lit("Invalid type '"), "type", F.lit("'")))), (bad_status, finding("ENUM_INVALID", F.concat(F.lit("Invalid status '"), "status", F.lit("'")))))


def enums(notes: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """types: (layer, allowed) of the domains that restrict types; a small table of folders."""
    return _rows(_with_types(parsed(notes), types), _enums())


def _tags() -> Column:
    def of(tag: Column) -> Column:
        spaced = tag.rlike(r"[\s\p{Z}]")
        return _found((spaced, finding("TAG_MALFORMED", F.concat(F.lit("Tag with white space '"), tag, F.lit("'")))), (~spaced & ~tag.rlike(TAG), finding("TAG_MALFORMED", F.concat(F.lit("Non-canonical tag '"), tag, F.lit("'")), WARNING)))

    return _of_each("tag_list", of)


def tags(notes: DataFrame) -> DataFrame:
    """Over tag_list: white space breaks the joined column; other spellings are repaired by the writer."""
    return _rows(parsed(notes), _tags())


def _aliases() -> Column:
    def of(alias: Column) -> Column:
        bad = F.coalesce(alias.rlike(r"[\n\r\t]") | (F.trim(alias) == ""), F.lit(True))
        return _found((bad, finding("ENUM_INVALID", F.concat(F.lit("Alias that isn't one line of text '"), F.regexp_replace(F.coalesce(alias, F.lit("")), r"\s+", " "), F.lit("'")))))

    return _of_each("alias_list", of)


def aliases(notes: DataFrame) -> DataFrame:
    """Over alias_list: an alias is text on one line."""
    return _rows(parsed(notes), _aliases())


def manifests(domains: DataFrame) -> DataFrame:
    """domains: domain, manifest_path, manifest_error.  A manifest that can't be read leaves its domain open."""
    return _each(domains.withColumn("rel_path", F.col("manifest_path")), (F.col("manifest_error").isNotNull(), finding("DOMAIN_MANIFEST_INVALID", F.col("manifest_error"))))


def _timestamps(generated: bool) -> list[Column]:
    bad = lambda at: F.coalesce(at != "", F.lit(False)) & ~valid_timestamp(at)
    entry = lambda v, i: _found((bad(v["at"]), finding("TIMESTAMP_INVALID", F.concat(F.lit("verified["), i.cast("string"), F.lit("].at: '"), v["at"], F.lit("'")))))
    found = [F.flatten(F.transform("verified", entry))]
    return [*found, _found((bad(F.col("generated.at")), finding("TIMESTAMP_INVALID", F.concat(F.lit("generated.at: '"), "generated.at", F.lit("'")))))] if generated else found


def timestamps(notes: DataFrame) -> DataFrame:
    """Over verified[].at, and generated.at where the notes have that column."""
    return _rows(parsed(notes), *_timestamps("generated" in notes.columns))


def _nesting() -> Column:
    return _found(((F.col("layer") == "wiki") & (F.size(F.split("rel_path", "/")) != 2), finding("WIKI_NESTING_DISALLOWED", F.lit("The wiki is flat"))))


def nesting(notes: DataFrame) -> DataFrame:
    return _rows(parsed(notes), _nesting())


def _verification() -> list[Column]:
    def entry(v: Column) -> Column:
        by, unbound = F.coalesce(v["by"], F.lit("")), F.coalesce(F.trim(v["of"]) == "", F.lit(True))
        return _found((~valid_actor(v["by"]), finding("ACTOR_MALFORMED", F.concat(F.lit("Malformed actor '"), by, F.lit("'")))), (unbound, finding("VERIFICATION_UNBOUND", F.concat(F.lit("Entry by '"), by, F.lit("' has no binding")))))

    human = lambda v: v["by"].startswith("human:")
    stale = F.filter("verified", lambda v: valid_actor(v["by"]) & F.coalesce(F.trim(v["of"]) != "", F.lit(False)) & (v["of"] != F.col("body_hash")) & (F.col("trust_tier") != "human-reviewed") & ((F.col("trust_tier") != "machine-confirmed") | human(v)))
    lead = F.coalesce(F.try_element_at(F.filter(stale, human), F.lit(-1)), F.try_element_at(stale, F.lit(-1)))["by"]
    return [_of_each("verified", entry), _found((lead.isNotNull(), finding("VERIFICATION_STALE", F.concat(F.lit("Entry by '"), lead, F.lit("' is stale")), WARNING)))]


def verification(notes: DataFrame) -> DataFrame:
    """Per entry: a malformed actor, a missing binding; per note: its leading stale entry, unless superseded."""
    return _rows(parsed(notes), *_verification())


def of_notes(notes: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """All gates that look at one note alone, in one pass over the notes."""
    fine = [_fields(), _enums(), _tags(), *_timestamps("generated" in notes.columns), _nesting(), *_verification(), *([_aliases()] if "alias_list" in notes.columns else [])]
    found = [F.when(F.col("parse_error").isNotNull(), _unparseable()), *[F.when(F.col("parse_error").isNull(), x) for x in fine]]
    return _rows(_with_types(notes.where("layer != 'raw'"), types), *found)


def dead_links(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Links that name no note, with the notes whose last segment they share, where there are any (three at most)."""
    rows = links.where("target_cid is null").select(F.col("source_cid").alias("cid"), "target_raw").join(parsed(notes).select("cid", "rel_path"), "cid")
    last = lambda c: F.lower(F.regexp_replace(F.regexp_extract(c, r"[^/]*\z", 0), r"\.md\z", ""))
    # of each name the first three notes; only dead links look one up
    names = samples.least(parsed(notes).select(last(F.col("cid")).alias("_last"), "cid"), ["_last"], "cid", 3).withColumnRenamed("first", "_near").drop("total")
    rows = rows.withColumn("_last", last(F.split_part(F.col("target_raw"), F.lit("#"), F.lit(1)))).join(names, "_last", "left")
    hint = F.when(F.col("_near").isNotNull(), F.concat(F.lit("; did you mean "), F.array_join("_near", ", "), F.lit("?"))).otherwise(F.lit(""))
    return _each(rows, (F.lit(True), finding("LINK_DEAD", F.concat(F.lit("Dead link '"), "target_raw", F.lit("'"), hint))))


def missing_anchors(links: DataFrame, headings: DataFrame) -> DataFrame:
    """links: rel_path, target_cid, anchor; headings: cid, headings.  One row a note on the right, so that hubs aren't multiplied by their headings."""
    named = F.exists("headings", lambda h: names_heading(F.col("anchor"), h["title"]))
    rows = links.where("anchor IS NOT NULL AND target_cid IS NOT NULL").dropDuplicates(["rel_path", "target_cid", "anchor"])
    rows = rows.join(headings.withColumnRenamed("cid", "target_cid"), "target_cid").where(~named)
    message = F.concat(F.lit("No heading '"), F.col("anchor"), F.lit("' in "), F.col("target_cid"))
    return rows.select(finding("ANCHOR_MISSING", message, WARNING).alias("f")).select("f.*")


def broken_raw_links(links: DataFrame, raw: DataFrame) -> DataFrame:
    """links: rel_path, target_raw of relative links; raw: path.

    Links whose path, as it is written, goes through a folder raw and leads to no raw file.  What stands after
    the last `raw` may be a raw file all the same: then the path that leads there from the note is suggested.
    """
    rows = links.dropDuplicates(["rel_path", "target_raw"]).withColumn("path", relative_path(F.col("rel_path"), F.col("target_raw")))
    steps = F.split(F.substring_index("target_raw", "#", 1), "/")
    rows = rows.where(F.array_contains(steps, "raw")).join(raw.select("path"), "path", "left_anti")
    after = F.slice(steps, F.size(steps) - F.array_position(F.reverse(steps), "raw").cast("int") + 2, F.size(steps))
    rows = rows.withColumn("_tail", relative_path(F.lit("raw/"), F.array_join(after, "/")))
    rows = rows.join(raw.select(F.col("path").alias("_tail"), F.col("path").alias("_there")), "_tail", "left")
    hint = F.when(F.col("_there").isNotNull(), F.concat(F.lit("; did you mean '"), spelled_path(relative_to(F.col("rel_path"), F.col("_there")), F.lit(False)), F.lit("'?"))).otherwise(F.lit(""))
    return _each(rows, (F.lit(True), finding("RAW_LINK_BROKEN", F.concat(F.lit("No raw file '"), F.col("target_raw"), F.lit("'"), hint))))


def missing_sources(notes: DataFrame, sources: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Citations of files that aren't there, and notes without citations in the domains that require them."""
    rows = sources.where("resolved_path is null").select(F.col("source_cid").alias("cid"), "raw_path").join(parsed(notes).select("cid", "rel_path"), "cid")
    unresolved = _each(rows, (F.lit(True), finding("SOURCE_MISSING", F.concat(F.lit("No raw file '"), "raw_path", F.lit("'")))))
    if not required:
        return unresolved
    bare = parsed(notes).where(F.col("layer").isin(*required)).join(sources.select(F.col("source_cid").alias("cid")), "cid", "left_anti")
    return unresolved.unionByName(_each(bare, (F.lit(True), finding("SOURCE_MISSING", F.concat(F.lit("Domain '"), "layer", F.lit("' requires sources"))))))


def orphan(notes: DataFrame, links: DataFrame) -> DataFrame:
    return _each(graph.orphans(notes, links), (F.lit(True), finding("NOTE_ORPHAN", F.lit("No link to or from this note"), WARNING)))


def lint(notes: DataFrame, links: DataFrame, sources: DataFrame, types: DataFrame | None = None, required: list[str] | None = None, anchors: tuple[DataFrame, DataFrame] | None = None, raw_links: tuple[DataFrame, DataFrame] | None = None, domains: DataFrame | None = None) -> DataFrame:
    """Findings of all gates; `ordered` sorts them.

    anchors: what `missing_anchors` takes; raw_links: what `broken_raw_links`
    takes; domains: what `manifests` takes.
    """
    gates = [of_notes(notes, types), dead_links(notes, links), missing_sources(notes, sources, required), orphan(notes, links)]
    gates += [gate(*given) for gate, given in ((missing_anchors, anchors), (broken_raw_links, raw_links)) if given]
    if domains is not None:
        gates.append(manifests(domains))
    return reduce(DataFrame.unionByName, gates)


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("rel_path", "code", "message")


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code", "severity").agg(F.count("*").alias("n"))
