"""Retrieval: named notes and raw files with their surroundings, each within a budget of tokens.

A call names a few targets (at most `TARGETS`); they are looked up by filters on
names, and only their rows are read.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import markdown
from marginalia.operators import graph

#: Targets of a call, tokens that may be asked for, and bytes of a raw file that are read.
TARGETS, TOKENS, RAW_BYTES = 50, 1_000_000, 1 << 20


class NotFound(LookupError):
    pass


def unwrapped(target: str) -> str:
    """A target without brackets, alias and leading dots: what is named, with its anchor."""
    text = target.strip().removeprefix("!").removeprefix("[[").removesuffix("]]").split("|")[0].strip().replace("\\", "/")
    while text.startswith("./"):
        text = text[2:]
    return text


def _named(listed: DataFrame, column: str, name: str) -> str | None:
    """The listed name itself, else the only one that differs in case."""
    rows = sorted(r[0] for r in listed.where(F.lower(column) == name.lower()).select(column).distinct().limit(TARGETS).collect())
    if name in rows:
        return name
    if len(rows) > 1:
        raise LookupError(f"'{name}' means several: {', '.join(rows)}")
    return rows[0] if rows else None


def _apart(name: str) -> list[tuple[str, str | None]]:
    """How a name may be read: whole, up to its first hash, up to its last."""
    found: list[tuple[str, str | None]] = [(name, None)]
    for cut in (name.partition("#"), name.rpartition("#")):
        if cut[1] and (cut[0], cut[2].strip() or None) not in found:
            found.append((cut[0], cut[2].strip() or None))
    return found


def _section(text: str, anchor: str | None, name: str) -> tuple[str, str | None, str | None]:
    """(text, heading, error): a section that isn't there leaves the whole text and says which there are."""
    if anchor is None:
        return text, None, None
    found = markdown.section(text, anchor)
    if found:
        return found[1], found[0], None
    there = ", ".join(f"'{h}'" for _, h in markdown.headings(text)) or "none"
    return text, None, f"no section '#{anchor}' in '{name}' (there are: {there})"


def _note(notes: DataFrame, links: DataFrame, sources: DataFrame, target: str, name: str, tokens: int | None, directives: dict[str, str]) -> dict[str, Any]:
    failed: Exception | None = None
    for whole, anchor in _apart(name):
        try:
            cid = _named(notes, "cid", whole.removesuffix(".md")) if anchor is None and "#" in whole else graph.resolve_cid(notes, whole)
        except LookupError as e:
            failed = failed or e
            continue
        if cid:
            break
    else:
        raise NotFound(str(failed or f"no note '{name}'"))
    row = notes.where(F.col("cid") == cid).first().asDict()
    if row.get("parse_error"):
        raise ValueError(f"'{cid}' can't be read: {row['parse_error']}")
    text, heading, error = _section(row["body"] or "", anchor, cid)
    content, kept, total = markdown.within_budget(text, tokens)
    names = lambda df: [r.asDict() for r in df.collect()]
    forward = graph.described(graph.forward(links, cid).withColumnRenamed("target_cid", "cid"), notes).orderBy(F.asc_nulls_last("cid")).limit(TOKENS)
    back = graph.described(graph.back(links, cid).withColumnRenamed("source_cid", "cid"), notes).orderBy("cid").limit(TOKENS)
    cited = sources.where(F.col("source_cid") == cid).select("raw_path", "resolved_path").orderBy("raw_path")
    found = {"target": target, "kind": "note", "cid": cid, "domain": row["layer"], "title": row["title"] or row["stem"], "type": row["type"], "status": row["status"], "trust_tier": row["trust_tier"], "section": heading, "directives": directives.get(row["layer"], ""), "content": content, "links": names(forward), "backlinks": names(back), "sources": names(cited), "truncated": kept < total or content != text}
    return found | ({"section_error": error} if error else {})


def _raw(raw: DataFrame, sources: DataFrame, target: str, name: str, tokens: int | None) -> dict[str, Any]:
    """raw: rel_path, body (empty for files that are known by name alone), is_text."""
    whole, _, tail = name.rpartition("#")
    path, anchor = _named(raw, "rel_path", name), None
    if path is None and whole:
        path, anchor = _named(raw, "rel_path", whole), tail.strip() or None
    if path is None:
        raise NotFound(f"no raw file '{name}'")
    cited = [r.source_cid for r in sources.where(F.col("resolved_path") == path).select("source_cid").distinct().orderBy("source_cid").collect()]
    found = {"target": target, "kind": "raw", "path": path, "section": None, "cited_by": cited}
    most = RAW_BYTES if tokens is None else min(RAW_BYTES, 16 * tokens)
    row = raw.where(F.col("rel_path") == path).select("is_text", F.substring("body", 1, most + 1).alias("body")).first()  # no more than can be given
    if not row.is_text:
        return found | {"content": None, "filename_only": True, "truncated": False}
    read = (row.body or "").encode()
    text = read[:most].decode(errors="ignore")
    text, heading, error = _section(text, anchor, path)
    content, kept, total = markdown.within_budget(text, tokens)
    found |= {"section": heading, "content": content, "filename_only": False, "truncated": len(read) > most or kept < total or content != text}
    return found | ({"section_error": error} if error else {})


def ground(notes: DataFrame, links: DataFrame, sources: DataFrame, raw: DataFrame, targets: list[str], tokens: int | None = None, directives: dict[str, str] | None = None) -> list[dict[str, Any]]:
    """For each target in order what was found, or {target, error}; if nothing was found at all, the first error is raised.

    A target under raw/ is a file, any other a note.  tokens: the budget of each.
    """
    if isinstance(targets, str) or not targets or len(targets) > TARGETS:
        raise ValueError(f"targets must be a list of 1 to {TARGETS} names")
    if tokens is not None and (isinstance(tokens, bool) or not isinstance(tokens, int) or not 0 < tokens <= TOKENS):
        raise ValueError(f"tokens must be a whole number up to {TOKENS}")
    found, failed = [], []
    for target in targets:
        name = unwrapped(target)
        try:
            found.append(_raw(raw, sources, target, name, tokens) if name.startswith("raw/") else _note(notes, links, sources, target, name, tokens, directives or {}))
        except (LookupError, ValueError) as e:
            failed.append(e)
            found.append({"target": target, "error": {"code": classify(e), "message": str(e)}})
    if len(failed) == len(found):
        raise failed[0]
    return found


def classify(error: Exception) -> str:
    """A failure's kind."""
    kinds = ((NotFound, "NOT_FOUND"), (LookupError, "AMBIGUOUS" if "several" in str(error) else "NOT_FOUND"), (FileExistsError, "ALREADY_EXISTS"), (PermissionError, "REFUSED"), (TimeoutError, "LOCKED"), (ValueError, "INVALID"), (OSError, "IO"))
    return next((code for kind, code in kinds if isinstance(error, kind)), "INTERNAL")
