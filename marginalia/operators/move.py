"""What becomes of links when notes move or appear: each link resolved under the names before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.markdown import relative_path, relative_to, spelled_path
from marginalia.functions.scalar import normal_path
from marginalia.operators import samples
from marginalia.operators.resolve import resolve


def _both(links: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct written targets with the notes that they name before and after (was, will); sources share the work."""
    written = links.select("target_raw").distinct()
    was = resolve(written, before).withColumnRenamed("target_cid", "was")
    return resolve(was, after).withColumnRenamed("target_cid", "will")


def _moved(cids: DataFrame, moves: DataFrame) -> DataFrame:
    """cid and where it will be (to): itself if it stays."""
    new = moves.groupBy("cid").agg(F.min("new_cid").alias("new_cid"))
    return cids.select("cid").distinct().join(new, "cid", "left").select("cid", F.coalesce("new_cid", "cid").alias("to"))


def plan(links: DataFrame, cids: DataFrame, moves: DataFrame) -> DataFrame:
    """links: source_cid, target_raw; cids: cid; moves: cid, new_cid.

    Rows (source_cid as it will be, target_raw, was, expected, will, action) of the links
    that a move would bend: `rewrite` where the text must change to keep naming a note that moves,
    `newly_resolved` where a dead link comes alive, `blocked` where a link to a note that stays
    would open another.  Links that keep their meaning don't show.
    """
    moved = _moved(cids, moves)
    names = _both(links, cids.select("cid").distinct(), moved.select(F.col("to").alias("cid")))
    there = moved.select(F.col("cid").alias("was"), F.col("to").alias("expected"))
    bent = names.join(there, "was", "left").where(~F.col("will").eqNullSafe(F.col("expected")))
    action = F.when(F.col("was").isNull(), "newly_resolved").when(F.col("was") != F.col("expected"), "rewrite").otherwise("blocked")
    sources = moved.select(F.col("cid").alias("source_cid"), F.col("to").alias("_to"))
    out = links.select("source_cid", "target_raw").distinct().join(bent, "target_raw").join(sources, "source_cid", "left")
    return out.select(F.coalesce("_to", "source_cid").alias("source_cid"), "target_raw", "was", "expected", "will", action.alias("action"))


def stable(cid: Column) -> Column:
    """The text of a wiki link that opens a note whatever other notes come: its path, or for a note of the wiki the path within it."""
    return F.regexp_replace(cid, r"\Awiki/", "")


def _is_stable(text: Column, cid: Column) -> Column:
    name = F.regexp_replace(normal_path(text), r"\.md\z", "")
    return (name == cid) | (name == stable(cid))


def plan_spans(spans: DataFrame, cids: DataFrame, moves: DataFrame) -> DataFrame:
    """What a move makes of every link that is written: wiki links by name, and relative paths of links, images and definitions.

    spans: source_cid, start, end, kind (wiki, markdown, image, definition), target, embed, angle
    (the path stands in angle brackets); places are those of the target's text in its note.

    Rows (source_cid before the move, start, end, kind, target, was, expected, will, action, text):
    - rewrite: `text` takes the target's place, so that the link names what it did;
    - fragile: a link to a note that moves stays as it is, but other notes may now take its name;
    - newly_resolved: a dead link comes alive;
    - blocked: a link to a note that stays would open another, or no text can name the new place.
    was, expected and will are notes for wiki links and paths for the others.  A rewrite inside
    another one of the same note is left out: the outer link carries it along.  Spans of one
    text nest and don't cross.
    """
    moved = _moved(cids, moves)
    places = moved.select(F.col("cid").alias("source_cid"), F.col("to").alias("_source"))
    at = spans.join(places, "source_cid", "left").withColumn("_source", F.coalesce("_source", "source_cid"))

    wiki = at.where("kind = 'wiki'")
    names = _both(wiki.select(F.col("target").alias("target_raw")), cids.select("cid").distinct(), moved.select(F.col("to").alias("cid"))).withColumnRenamed("target_raw", "target")
    there = moved.select(F.col("cid").alias("was"), F.col("to").alias("expected"))
    named = wiki.join(names.join(there, "was", "left"), "target")
    moves_on, bent = F.col("was") != F.col("expected"), ~F.col("will").eqNullSafe(F.col("expected"))
    fragile = moves_on & _is_stable(F.col("target"), F.col("was")) & ~_is_stable(F.col("target"), F.col("expected"))
    action = F.when(bent & F.col("was").isNull(), "newly_resolved").when(bent & moves_on, "rewrite").when(bent, "blocked").when(fragile, "fragile")
    plain = stable(F.col("expected"))
    # an embedded name with a suffix is a file's, unless it says that it is a note's
    text = F.when(F.col("embed") & F.regexp_like(plain, F.lit(r"\.[A-Za-z0-9]+\z")), F.concat(plain, F.lit(".md"))).otherwise(plain)
    named = named.withColumn("action", action).withColumn("text", F.when(F.col("action") == "rewrite", text))
    # read back: signs that end a name, or a name that opens another note
    unread = F.regexp_like("text", F.lit(r"[\[\]|#\n]"))
    again = resolve(named.where("action = 'rewrite'").select(F.col("text").alias("target_raw")).distinct(), moved.select(F.col("to").alias("cid"))).select(F.col("target_raw").alias("text"), F.col("target_cid").alias("_again"))
    named = named.join(again, "text", "left")
    named = named.withColumn("action", F.when((F.col("action") == "rewrite") & (unread | ~F.col("_again").eqNullSafe(F.col("expected"))), "blocked").otherwise(F.col("action")))

    paths = at.where("kind <> 'wiki'").withColumn("was", relative_path(F.concat(F.col("source_cid"), F.lit(".md")), F.col("target")))
    files = moved.select(F.concat("cid", F.lit(".md")).alias("was"), F.concat("to", F.lit(".md")).alias("_to"))
    comes = moved.where("to <> cid").select(F.concat("to", F.lit(".md")).alias("was"), F.lit(True).alias("_comes"))
    paths = paths.join(files, "was", "left").join(comes, "was", "left").where("was IS NOT NULL")
    paths = paths.withColumns({"expected": F.coalesce("_to", "was"), "will": relative_path(F.concat(F.col("_source"), F.lit(".md")), F.col("target"))})
    goes = F.col("_source") != F.col("source_cid")
    note = (F.col("kind") != "image") & F.lower("target").endswith(".md") & ~F.array_contains(F.split("target", "/"), "raw")
    alive = F.col("_to").isNull() & F.col("_comes").isNotNull()
    rewrite = F.when(goes, ~F.col("will").eqNullSafe(F.col("expected"))).otherwise(note & (F.col("expected") != F.col("was")))
    paths = paths.withColumn("action", F.when(rewrite, "rewrite").when(~goes & note & alive, "newly_resolved"))
    paths = paths.withColumn("text", F.when(F.col("action") == "rewrite", spelled_path(relative_to(F.concat(F.col("_source"), F.lit(".md")), F.col("expected")), F.coalesce("angle", F.lit(False)))))
    wrong = ~relative_path(F.concat(F.col("_source"), F.lit(".md")), F.col("text")).eqNullSafe(F.col("expected")) | F.regexp_like("text", F.lit(r"[\n<>]"))
    paths = paths.withColumn("action", F.when((F.col("action") == "rewrite") & wrong, "blocked").otherwise(F.col("action")))

    shown = ["source_cid", "start", "end", "kind", "target", "was", "expected", "will", "action", "text"]
    every = named.select(*shown).unionByName(paths.select(*shown)).where("action IS NOT NULL")
    edits = F.when(F.col("text").isNotNull(), F.col("end"))
    before = F.max(edits).over(W.partitionBy("source_cid").orderBy("start", F.desc("end")).rowsBetween(W.unboundedPreceding, -1))
    return every.withColumn("_before", before).where(F.col("text").isNull() | F.col("_before").isNull() | (F.col("start") >= F.col("_before"))).drop("_before")


def fragile_warnings(planned: DataFrame, shown: int = 3) -> DataFrame:
    """cid (where a moved note will be), first (of the links that only its name keeps: source and target), total."""
    rows = planned.where("action = 'fragile'").select(F.col("expected").alias("cid"), F.format_string("%s.md: [[%s]]", "source_cid", "target").alias("link"))
    return samples.least(rows, ["cid"], "link", shown)


def approvals(planned: DataFrame, notes: DataFrame) -> DataFrame:
    """cid, trust_tier of notes whose text the plan changes while an attestation holds for it: these go stale, so someone has to agree."""
    changed = planned.where("action = 'rewrite'").select(F.col("source_cid").alias("cid")).distinct()
    return notes.where("trust_tier IN ('human-reviewed', 'machine-confirmed')").join(changed, "cid", "left_semi").select("cid", "trust_tier")


def collisions(cids: DataFrame, moves: DataFrame) -> DataFrame:
    """new_cid that would name several notes, or one that stays: such a move is refused."""
    return _moved(cids, moves).groupBy(F.col("to").alias("new_cid")).agg(F.count("*").alias("notes")).where("notes > 1")


def takeovers(links: DataFrame, cids: DataFrame, created: DataFrame) -> DataFrame:
    """target_raw, was, will of live links that new notes would take over."""
    before = cids.select("cid").distinct()
    names = _both(links, before, before.unionByName(created.select("cid")).distinct())
    return names.where("was IS NOT NULL AND NOT (was <=> will)").select("target_raw", "was", "will")
