"""Folders of notes as tables: each .md file with its header, body, links and hash."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import scalar
from marginalia.functions.frontmatter import parsed_column
from marginalia.functions.markdown import edge_array
from marginalia.functions.text import camel_subwords
from marginalia.sources.files import collection

_ENTRY = "array<struct<by: string, at: string, of: string>>"


def files(spark: SparkSession, root: str, templates: str = "") -> DataFrame:
    """rel_path, text, file_size, mtime of all notes below `root`; bytes that aren't UTF-8 are replaced.

    A folder that every machine sees is read by the collection source.  An
    address with a scheme is read by Spark's own listing, which leaves out names
    that start with an underscore; neither shows hidden and ignored folders.
    """
    local = re.sub(r"\Afile:(//)?", "", root)
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", local):
        rows = collection(spark, local.rstrip("/"), "notes", templates)
        return rows.select("rel_path", F.decode("content", "UTF-8").alias("text"), "file_size", "mtime")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    rel = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    found = rows.select(rel.alias("rel_path"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("file_size"), F.unix_micros("modificationTime").cast("double").__truediv__(1e6).alias("mtime"))
    return found.where(scalar.path_violation(F.col("rel_path"), templates or None).isNull())


def raw(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """Raw files as rows of the corpus `raw`: the text of those with one of the suffixes, else an empty body; the name is the title.

    files: rel_path, content, file_size, mtime.
    """
    suffix = F.lower(F.regexp_extract("rel_path", r"[^/.](\.[^./]+)\z", 1))
    body = F.when(suffix.isin([x.lower() for x in suffixes]), F.decode("content", "UTF-8")).otherwise(F.lit(""))
    return files.where(scalar.source_violation(F.col("rel_path")).isNull()).select(
        "rel_path", F.col("rel_path").alias("cid"), F.regexp_extract("rel_path", r"[^/]*\z", 0).alias("title"), F.regexp_extract("rel_path", r"[^/]*\z", 0).alias("stem"), F.lit("raw").alias("layer"), body.alias("body"), F.sha2("content", 256).alias("file_hash"), "file_size", "mtime", F.lit(None).cast("string").alias("parse_error")
    )


def notes(files: DataFrame) -> DataFrame:
    """One row a file: identity, header fields, body, its hash and what stands against its header."""
    rows = files.withColumn("p", parsed_column("text"))
    field = lambda name: F.get_json_object("p.fields", f"$.{name}")
    rows = rows.select(
        "rel_path", "file_size", "mtime", scalar.cid_of(F.col("rel_path")).alias("cid"), scalar.stem_of(F.col("rel_path")).alias("stem"), scalar.layer_of(F.col("rel_path")).alias("layer"),
        *(field(f).alias(f) for f in ("title", "description", "type", "status")),
        F.coalesce(F.from_json(field("tags"), "array<string>"), F.array().cast("array<string>")).alias("tag_list"),
        F.transform(F.coalesce(F.from_json(field("aliases"), "array<string>"), F.array().cast("array<string>")), lambda a: a).alias("alias_list"),
        F.coalesce(F.from_json(field("sources"), "array<string>"), F.array().cast("array<string>")).alias("source_list"),
        F.from_json(field("generated"), "struct<by: string, at: string>").alias("generated"),
        F.from_json(field("verified"), _ENTRY).alias("verified"),
        F.col("p.fields").alias("fields"), F.col("p.body").alias("body"), F.col("p.error").alias("parse_error"), F.col("p.line").alias("parse_line"),
    )
    aliases = F.array_join(scalar.canonical_aliases(F.col("alias_list")), " ")
    rows = rows.withColumns({"tags": F.array_join(scalar.canonical_tags(F.col("tag_list")), " "), "aliases": aliases})
    rows = rows.withColumn("subwords", F.array_join(camel_subwords(F.concat_ws(" ", "title", "description", "aliases", "body")), " "))
    hashed = rows.withColumn("body_hash", scalar.body_hash(F.col("body")))
    return hashed.withColumn("trust_tier", scalar.trust_tier(F.col("verified"), F.col("body_hash")))


def note_links(notes: DataFrame) -> DataFrame:
    """source_cid, kind, target_raw, target, anchor, alias, occurrences: the links of notes that parse; alias is the first that is written."""
    edges = notes.where("parse_error IS NULL").select(F.col("cid").alias("source_cid"), F.posexplode(edge_array("body")).alias("pos", "e")).select("source_cid", "pos", "e.kind", "e.target_raw", "e.target", "e.anchor", "e.alias")
    return edges.groupBy("source_cid", "kind", "target_raw", "target", "anchor").agg(F.count("*").alias("occurrences"), F.min(F.when(F.col("alias").isNotNull(), F.struct("pos", "alias")))["alias"].alias("alias"))


def note_sources(notes: DataFrame, raw: DataFrame) -> DataFrame:
    """source_cid, raw_path, resolved_path: what notes cite, and the raw file (rel_path) that it is, null where there is none."""
    cited = notes.where("parse_error IS NULL").select(F.col("cid").alias("source_cid"), F.explode(F.array_distinct("source_list")).alias("raw_path"))
    # as a path without steps that stand still or go back
    folded = F.aggregate(F.filter(F.split(F.replace("raw_path", F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", ".")), F.array().cast("array<string>"), lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    named = cited.withColumn("_path", F.array_join(folded, "/"))
    return named.join(raw.select(F.col("rel_path").alias("_path"), F.col("rel_path").alias("resolved_path")), "_path", "left").select("source_cid", "raw_path", "resolved_path")
