"""Names to notes: a name index built by windows, looked up by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.markdown import relative_path
from marginalia.functions.scalar import normal_path
from marginalia.functions.text import once


def names(cids: DataFrame) -> DataFrame:
    """kind (exact, suffix, stem), name, cid, prio for every name that a note answers to."""
    prio = F.when(F.col("cid").startswith("wiki/"), 0).when(F.col("cid").startswith("archive/"), 2).otherwise(1)
    base = cids.select("cid", prio.alias("prio"), F.split("cid", "/").alias("parts")).withColumn("n", F.size("parts"))
    exact = base.select(F.lit("exact").alias("kind"), F.col("cid").alias("name"), "cid", "prio")
    short = base.where(F.col("cid").startswith("wiki/")).select(F.lit("exact").alias("kind"), F.expr("substring(cid, 6)").alias("name"), "cid", "prio")
    tails = base.where("n >= 3").select("cid", "prio", "parts", "n", F.explode(F.expr("sequence(2, n - 1)")).alias("i"))
    suffix = tails.select(F.lit("suffix").alias("kind"), F.array_join(F.expr("slice(parts, i, n - i + 1)"), "/").alias("name"), "cid", "prio")
    stem = base.select(F.lit("stem").alias("kind"), F.element_at("parts", -1).alias("name"), "cid", "prio")
    return exact.unionByName(short).unionByName(suffix).unionByName(stem)


def index(cids: DataFrame) -> DataFrame:
    """The note that each name of each kind resolves to: wiki first, archive last, then by cid."""
    best = F.min(F.struct("prio", "cid"))  # a partial aggregate, so a common stem is no hot group
    return names(cids).groupBy("kind", "name").agg(best.alias("best")).select("kind", "name", F.col("best.cid").alias("cid"))


def probes(links: DataFrame) -> DataFrame:
    """Adds `by` and `name` to links (source_cid, kind, target): a wiki link asks for a note by name, a Markdown link by the path that it leads to.

    A link that can't lead to a note asks for nothing: `by` is null.
    """
    written = F.regexp_replace(normal_path(F.col("target")), r"\.md\z", "")
    led = relative_path(F.concat(F.col("source_cid"), F.lit(".md")), F.col("target"))
    path = once(led, lambda p: F.when(F.lower(p).endswith(".md"), F.regexp_replace(p, r"(?i)\.md\z", "")))
    name = F.when(F.col("kind") == "wiki", written).when(F.col("kind") == "markdown", path)
    return links.withColumn("name", once(name, lambda n: F.when(n != "", n))).withColumn("by", F.when(F.col("name").isNotNull(), F.col("kind")))


def lookup(asked: DataFrame, cids: DataFrame, unparseable: DataFrame | None = None) -> DataFrame:
    """asked (by, name), distinct, with cid: names by exact name, path suffix, then bare stem; paths by the exact cid.

    Only names that are asked for are ranked.  What means an unparseable note has no cid, and never another.
    """
    some = names(cids).join(asked.select("name").distinct(), "name", "left_semi")
    best = some.groupBy("name", "kind").agg(F.min(F.struct("prio", "cid")).alias("best"))
    one = best.groupBy("name").agg(*[F.max(F.when(F.col("kind") == k, F.col("best.cid"))).alias(k) for k in ("exact", "suffix", "stem")])
    at = asked.join(one, "name", "left")
    path = F.when(F.col("exact") == F.col("name"), F.col("exact"))
    wiki = F.coalesce("exact", "suffix", F.when(F.instr("name", "/") == 0, F.col("stem")))
    found = at.select("by", "name", F.when(F.col("by") == "markdown", path).otherwise(wiki).alias("cid"))
    if unparseable is None:
        return found
    bad = unparseable.select("cid", F.lit(True).alias("_bad")).distinct()
    return found.join(bad, "cid", "left").select("by", "name", F.when(F.col("_bad").isNull(), F.col("cid")).alias("cid"))


def edges(links: DataFrame, cids: DataFrame, unparseable: DataFrame | None = None) -> DataFrame:
    """Adds target_cid to links (source_cid, kind, target) of either kind, in one plan; each name is looked up once."""
    asked = probes(links)
    found = lookup(asked.where("by IS NOT NULL").select("by", "name").distinct(), cids, unparseable)
    return asked.join(found.withColumnRenamed("cid", "target_cid"), ["by", "name"], "left").drop("by", "name")


def lookup_again(found: DataFrame, asked: DataFrame, changed: DataFrame, cids: DataFrame, unparseable: DataFrame | None = None) -> DataFrame:
    """`lookup` of asked (by, name), from what an earlier one found and the notes (cid) that came, went or changed since.

    Only names that a changed note answers to, and names that weren't asked for before, are looked up; the rest is kept.
    """
    touched = names(changed.select("cid").distinct()).select("name").distinct()
    known = asked.join(found.withColumn("_known", F.lit(True)), ["by", "name"], "left").join(touched.withColumn("_touched", F.lit(True)), "name", "left")
    stays = F.col("_known").isNotNull() & F.col("_touched").isNull()
    kept = known.where(stays).select("by", "name", "cid")
    return kept.unionByName(lookup(known.where(~stays).select("by", "name"), cids, unparseable))


def resolve(links: DataFrame, cids: DataFrame, unparseable: DataFrame | None = None) -> DataFrame:
    """Adds target_cid to links (source_cid, target_raw): exact name, else path suffix, else bare stem.

    What resolves to an unparseable note is null; it never falls through to another.
    """
    known = index(cids)
    probe = links.withColumn("_name", F.regexp_replace(normal_path(F.col("target_raw")), r"\.md\z", ""))
    for kind in ("exact", "suffix", "stem"):
        probe = probe.join(known.where(F.col("kind") == kind).select(F.col("name").alias("_name"), F.col("cid").alias(f"_{kind}")), "_name", "left")
    found = F.coalesce("_exact", "_suffix", F.when(F.instr("_name", "/") == 0, F.col("_stem")))
    out = probe.withColumn("target_cid", found).drop("_name", "_exact", "_suffix", "_stem")
    if unparseable is not None:
        bad = unparseable.select(F.col("cid").alias("target_cid"), F.lit(True).alias("_bad")).distinct()
        out = out.join(bad, "target_cid", "left").withColumn("target_cid", F.when(F.col("_bad").isNull(), F.col("target_cid"))).drop("_bad")
    return out


def candidates(probes: DataFrame, cids: DataFrame) -> DataFrame:
    """(name, cid): every note that a name could mean; an exact name is one note; active ones before archived ones."""
    every = names(cids)
    exact = index(cids).where("kind = 'exact'").select("name", "cid")
    hit = probes.select("name").distinct().join(exact, "name")
    rest = probes.select("name").distinct().join(exact.select("name"), "name", "left_anti")
    kind = F.when(F.instr("name", "/") > 0, "suffix").otherwise("stem")
    other = rest.withColumn("kind", kind).join(every.select("kind", "name", "cid").distinct(), ["kind", "name"])
    live = other.where(~F.col("cid").startswith("archive/")).select("name", F.lit(True).alias("_live")).distinct()
    other = other.join(live, "name", "left").where(F.col("_live").isNull() | ~F.col("cid").startswith("archive/"))
    return hit.unionByName(other.select("name", "cid"))
