"""Scalar functions over paths, names, hashes, tags and attestations, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import casefolded

#: Fixed values.
STATUSES = ("active", "evergreen", "draft", "completed", "deprecated", "abandoned")
RETIRED = ("deprecated", "abandoned")
MANIFEST = "AGENTS.md"
IGNORED_FOLDERS = (".git", ".obsidian", ".venv", "venv", "node_modules", "__pycache__", "target", "dist", "build", ".pytest_cache")
ACTOR = r"\A(human|agent|process):[A-Za-z0-9._\-/]+\z"
TIMESTAMP = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z\z"
TAG = r"\A[a-z0-9]+(-[a-z0-9]+)*(/[a-z0-9]+(-[a-z0-9]+)*)*\z"


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\A/+|/+\z", "")


def layer_of(path: Column) -> Column:
    clean = normal_path(path)
    return F.when(F.instr(clean, "/") > 0, F.split_part(clean, F.lit("/"), F.lit(1))).otherwise("root")


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(normal_path(path), r"[^/]*\z", 0), r"(.)\.[^.]*\z", "$1")


def cid_of(path: Column) -> Column:
    clean = normal_path(path)
    whole = F.split_part(clean, F.lit("/"), F.lit(1)).isin("raw", "log") | ~clean.endswith(".md")
    return F.when(whole, clean).otherwise(F.regexp_replace(clean, r"\.md\z", ""))


def path_of(cid: Column) -> Column:
    clean = F.regexp_replace(F.replace(cid, F.lit("\\"), F.lit("/")), r"/+\z", "")
    whole = F.split_part(clean, F.lit("/"), F.lit(1)).isin("raw", "log") | clean.endswith(".md")
    return F.when(whole, clean).otherwise(F.concat(clean, F.lit(".md")))


def path_violation(path: Column, template: str | None = None, for_write: bool = False) -> Column:
    """The first reason why a path can't name a note, or null.

    template: the folder of templates, which holds none.  for_write adds that the
    wiki is flat: a nested wiki note is read, but none is made.
    """
    clean = normal_path(path)
    parts = F.split(clean, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    hidden = F.exists(folders, lambda p: p.startswith(".") | p.isin(*IGNORED_FOLDERS))
    found = F.when((path == "") | path.rlike(r"\A[/\\]"), "absolute").when((F.size(parts) < 2) | F.exists(parts, lambda p: p.isin("", ".", "..")), "root")
    found = found.when(hidden, "hidden").when(parts[0].isin("raw", "log"), "reserved")
    if template:
        found = found.when(clean.startswith(template.replace("\\", "/").strip("/") + "/"), "template")
    found = found.when(name == MANIFEST, "manifest").when(name.startswith(".") | ~name.endswith(".md"), "suffix")
    return found.when((parts[0] == "wiki") & (F.size(parts) > 2), "nested") if for_write else found


def source_violation(path: Column) -> Column:
    """The first reason why a path can't name a raw file, or null."""
    parts = F.split(path, "/")
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    hidden = F.exists(inner, lambda p: p.startswith(".") | p.isin(*IGNORED_FOLDERS))
    return F.when(F.instr(path, "\\") > 0, "separator").when((F.size(parts) < 2) | (parts[0] != "raw"), "folder").when(F.exists(parts, lambda p: p.isin("", ".", "..")), "segment").when(hidden, "hidden").when(F.element_at(parts, -1).startswith("."), "dotfile")


#: White space that a line loses at its end.
_BLANK = "\t\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def body_hash(body: Column) -> Column:
    """Of the body with line ends made one kind, lines stripped at their ends, and blank edge lines dropped."""
    text = F.replace(F.replace(body, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.rtrim(x, F.lit(_BLANK)))
    return F.concat(F.lit("sha256:"), F.sha2(F.btrim(F.array_join(lines, "\n"), F.lit("\n")), 256))


def canonical_tag(tag: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(tag), "_+", "-"), r"\A-+|-+\z", "")


def canonical_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, canonical_tag), lambda t: t != ""))


def valid_actor(actor: Column) -> Column:
    return F.coalesce(actor.rlike(ACTOR), F.lit(False))


def valid_timestamp(at: Column) -> Column:
    date, hms = F.substring(at, 1, 10), F.substring(at, 12, 8)
    in_range = (F.substring(hms, 1, 2) <= "23") & (F.substring(hms, 4, 2) <= "59") & (F.substring(hms, 7, 2) <= "59")
    return F.coalesce(at.rlike(TIMESTAMP) & F.try_to_date(date, "yyyy-MM-dd").isNotNull() & in_range, F.lit(False))


def file_stem(title: Column) -> Column:
    """The name that a title gives a file: letters and digits in lower case, anything between them that is a space, hyphen or underscore as one hyphen."""
    kept = F.lower(F.regexp_replace(title, r"(?U)[^\w\s\-]", ""))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(kept, r"(?U)[\-\s_]+", "-"), F.lit("-")), F.lit("")), F.lit("untitled"))


def actor_name(actor: Column) -> Column:
    """The part of an actor after its kind."""
    return F.regexp_replace(actor, r"\A(human|agent|process):", "")


def canonical_aliases(aliases: Column) -> Column:
    """Without space around them, and without those that differ from an earlier one in case alone, or are empty."""
    stripped = F.filter(F.transform(aliases, lambda a: F.regexp_replace(a, r"(?U)\A\s+|\s+\z", "")), lambda a: a != "")
    first = F.transform(stripped, lambda a, i: F.struct(a.alias("a"), (F.array_position(F.transform(stripped, casefolded), casefolded(a)) == i + 1).alias("first")))
    return F.transform(F.filter(first, lambda x: x["first"]), lambda x: x["a"])


def trust_tier(verified: Column, current: Column) -> Column:
    """verified: array of structs (by, of).  A bound human entry beats a bound machine entry; anything else is stale."""
    bound = lambda who: F.exists(verified, lambda v: valid_actor(v["by"]) & v["by"].rlike(who) & (v["of"] == current))
    return F.when(verified.isNull() | (F.size(verified) == 0), "unverified").when(F.coalesce(bound("^human:"), F.lit(False)), "human-reviewed").when(F.coalesce(bound("^(agent|process):"), F.lit(False)), "machine-confirmed").otherwise("stale-verified")


def latest_stale_actor(verified: Column, current: Column) -> Column:
    stale = F.filter(verified, lambda v: valid_actor(v["by"]) & F.coalesce(F.trim(v["of"]) != "", F.lit(False)) & (v["of"] != current))
    return F.try_element_at(stale, F.lit(-1))["by"]
