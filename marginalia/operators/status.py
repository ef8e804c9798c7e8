"""Roll-ups and worklists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.scalar import latest_stale_actor
from marginalia.operators import graph


def by(notes: DataFrame, column: str) -> DataFrame:
    """Counts of notes, raw files left out, by a column as it is stored."""
    return notes.where("layer != 'raw'").groupBy(column).agg(F.count("*").alias("n"))


def folded(notes: DataFrame, column: str, default: str) -> dict[str, int]:
    """The same as a dictionary: null and empty values take the default's key, and the later of them replaces the earlier."""
    rows = sorted((r[0] or "", r.n) for r in by(notes, column).collect())  # one row for each value of an enumeration
    out: dict[str, int] = {}
    for value, n in rows:
        out[value or default] = n
    return out


def totals(notes: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    raw = notes.where("layer = 'raw'")
    one = notes.agg(F.count_if(F.col("layer") != "raw").alias("total_notes"), F.count_if(F.col("layer") == "wiki").alias("total_wiki"), F.count_if(F.col("layer") == "raw").alias("total_raw"), F.count_if((F.col("layer") != "raw") & (F.col("trust_tier") == "stale-verified")).alias("verification_debt"))
    todo = graph.unprocessed_raw(raw, sources).agg(F.count("*").alias("unprocessed_raw"))
    dead = links.agg(F.count_if(F.col("target_cid").isNull()).alias("broken_links"))
    return one.crossJoin(F.broadcast(todo)).crossJoin(F.broadcast(dead))  # one row each


def verification_debt(notes: DataFrame) -> DataFrame:
    """Active stale notes: cid, and whether a human owes the review."""
    rows = notes.where(f"trust_tier = 'stale-verified' and parse_error is null and layer != 'archive' and {graph.ACTIVE}")
    actor = latest_stale_actor(F.col("verified"), F.col("body_hash"))
    return rows.select("cid", F.coalesce(actor.startswith("human:"), F.lit(False)).alias("human_owed"))


def raw_extensions(raw: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract("rel_path", r"[^/.](\.[^./]+)\z", 1))
    return raw.groupBy(suffix.alias("extension")).agg(F.count("*").alias("n"))


#: Fixed value: how many items of a worklist are listed.
LISTED = 25


def worklists(notes: DataFrame, links: DataFrame, sources: DataFrame, limit: int = LISTED) -> DataFrame:
    """queue, rank, item, total: at most `limit` of each worklist by item, and how many there are."""
    debt = verification_debt(notes)
    parts = [("unfiled", graph.unfiled(notes, links), "cid"), ("raw", graph.unprocessed_raw(notes.where("layer = 'raw'"), sources), "rel_path"), ("human_owed", debt.where("human_owed"), "cid"), ("agent_payable", debt.where("not human_owed"), "cid")]
    every = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("queue"), F.col(key).alias("item")) for name, df, key in parts])
    totals = every.groupBy("queue").agg(F.count("*").alias("total"))
    ranked = every.withColumn("rank", F.row_number().over(W.partitionBy("queue").orderBy("item"))).where(F.col("rank") <= limit)
    return ranked.join(F.broadcast(totals), "queue").select("queue", "rank", "item", "total")  # a row for each queue


def gap_report(notes: DataFrame, links: DataFrame, sources: DataFrame, limit: int = LISTED) -> DataFrame:
    """part, pos, line of a report in Markdown: entry points, unfiled notes, raw files that nothing cites, and reviews that are due.

    A part without items isn't there; one with more than `limit` says how many more.
    """
    entries = graph.entry_points(notes).select(F.lit("entry_points").alias("queue"), F.col("cid").alias("item"), "description")
    total = entries.groupBy("queue").agg(F.count("*").alias("total"))
    first = entries.withColumn("rank", F.row_number().over(W.partitionBy("queue").orderBy("item"))).where(F.col("rank") <= limit).join(F.broadcast(total), "queue")
    rest = worklists(notes, links, sources, limit).withColumn("description", F.lit(None).cast("string"))
    rows = first.select("queue", "rank", "item", "description", "total").unionByName(rest.select("queue", "rank", "item", "description", "total"))
    titles = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    cell = F.regexp_replace(F.replace(F.coalesce("description", F.lit("")), F.lit("|"), F.lit("\\|")), r"\s+", " ")
    link = F.when(F.col("queue") == "raw", F.concat(F.lit("`"), "item", F.lit("`"))).otherwise(F.concat(F.lit("[["), "item", F.lit("]]")))
    item = F.struct((F.col("rank") + 1).alias("pos"), F.concat(F.lit("- "), link, F.when(cell != "", F.concat(F.lit(": "), cell)).otherwise(F.lit(""))).alias("line"))
    head = F.when(F.col("rank") == 1, F.struct(F.lit(0).alias("pos"), F.concat(F.lit("## "), titles[F.col("queue")], F.lit(" ("), F.col("total").cast("string"), F.lit(")")).alias("line")))
    more = F.when((F.col("rank") == limit) & (F.col("total") > limit), F.struct(F.lit(limit + 2).alias("pos"), F.concat(F.lit("- and "), (F.col("total") - limit).cast("string"), F.lit(" more")).alias("line")))
    return rows.select(F.col("queue").alias("part"), F.explode(F.array_compact(F.array(head, item, more))).alias("x")).select("part", "x.pos", "x.line")


def write_report(report: DataFrame, path: str) -> bool:
    """Writes the report's lines (a few per part) to a file if they differ from what is there; whether they did."""
    import pathlib

    order = {name: k for k, name in enumerate(TITLES)}
    lines = [r.line for r in sorted(report.collect(), key=lambda r: (order[r.part], r.pos))]
    text, file = "\n".join([*lines, ""]) if lines else "", pathlib.Path(path)
    if file.exists() and file.read_text("utf-8") == text:
        return False
    file.write_text(text, "utf-8")
    return True


TITLES = {"entry_points": "Entry points", "unfiled": "Unfiled notes", "raw": "Raw files without citations", "human_owed": "Reviews that a human owes", "agent_payable": "Reviews that an agent can do"}


def queues(notes: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """queue, n of each worklist."""
    debt = verification_debt(notes)
    parts = [("unfiled", graph.unfiled(notes, links)), ("raw", graph.unprocessed_raw(notes.where("layer = 'raw'"), sources)), ("human_owed", debt.where("human_owed")), ("agent_payable", debt.where("not human_owed"))]
    frames = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("queue"), "n") for name, df in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
