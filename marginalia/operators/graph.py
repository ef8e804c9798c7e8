"""Link-graph analytics over `links` (source_cid, target_cid, occurrences): joins on keys, no pairs of unrelated notes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import folded
from marginalia.operators import overlap, samples
from marginalia.operators.resolve import candidates
from marginalia.sources.shared import shared_dir

RESOLVED = "target_cid is not null"


def distinct_edges(links: DataFrame) -> DataFrame:
    return links.where(RESOLVED).select("source_cid", "target_cid").distinct()


def forward(links: DataFrame, cid: str) -> DataFrame:
    return links.where(F.col("source_cid") == cid).groupBy("target_cid").agg(F.sum("occurrences").alias("occurrences"))


def back(links: DataFrame, cid: str) -> DataFrame:
    return links.where(F.col("target_cid") == cid).groupBy("source_cid").agg(F.sum("occurrences").alias("occurrences"))


#: What a neighbour is shown with, and how many of each kind.
SHOWN = ("title", "type", "status", "trust_tier")
NEIGHBOURS = 20


def described(rows: DataFrame, notes: DataFrame, key: str = "cid") -> DataFrame:
    """Rows (key) with the note's metadata; a note that isn't there shows nulls."""
    known = notes.select(F.col("cid").alias(key), *SHOWN)
    return rows.join(known, key, "left")


def note_graph(notes: DataFrame, links: DataFrame, cid: str, limit: int = NEIGHBOURS, least: int = 1) -> DataFrame:
    """kind, rank, cid, n, total and metadata of a note's surroundings, at most `limit` of each kind.

    Kinds: forward and back (n: occurrences), forward_2 and back_2 (n: paths of two
    links, not through the note and not to its neighbours), co_cited and coupled
    (n: notes in common), all resolved.  Most first, then by cid; total counts the
    whole kind.  A note without links gives no rows.
    """
    e = distinct_edges(links)
    live = links.where(RESOLVED)
    one = [("forward", forward(live, cid).select(F.col("target_cid").alias("cid"), F.col("occurrences").alias("n"))), ("back", back(live, cid).select(F.col("source_cid").alias("cid"), F.col("occurrences").alias("n")))]
    for name, start, end in (("forward_2", "source_cid", "target_cid"), ("back_2", "target_cid", "source_cid")):
        near = e.where((F.col(start) == cid) & (F.col(end) != cid)).select(F.col(end).alias("near"))
        far = e.join(near, F.col(start) == F.col("near")).groupBy(F.col(end).alias("cid")).agg(F.count("*").alias("n")).where(F.col("cid") != cid)
        one.append((name, far.join(near, F.col("cid") == F.col("near"), "left_anti")))
    one += [("co_cited", co_citation(links, cid, least).select(F.col("b").alias("cid"), "n")), ("coupled", coupling(links, cid, least).select(F.col("b").alias("cid"), "n"))]
    every = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind"), "cid", "n") for k, df in one])
    ranked = every.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "cid"))).where(F.col("rank") <= limit)
    totals = every.groupBy("kind").agg(F.count("*").alias("total"))
    return described(ranked.join(F.broadcast(totals), "kind"), notes).select("kind", "rank", "cid", "n", "total", *SHOWN)  # six rows of totals


VIEWS = ("neighborhood", "hubs", "entry_points", "unfiled", "orphans")


def view(notes: DataFrame, links: DataFrame, name: str, target: str | None = None, limit: int = NEIGHBOURS) -> DataFrame:
    """A view of the graph by name; only a neighbourhood has a target, and it needs one."""
    if name not in VIEWS:
        raise ValueError(f"unknown view '{name}'; one of {', '.join(VIEWS)}")
    if isinstance(limit, bool) or not isinstance(limit, int) or not 0 < limit <= 1000:
        raise ValueError("limit must be a whole number from 1 to 1000")
    if (name == "neighborhood") != bool(target):
        raise ValueError("a neighborhood needs a target" if not target else f"view '{name}' takes no target")
    if name == "neighborhood":
        return note_graph(notes, links, target, limit)
    if name == "hubs":
        return hub_overview(notes, links, limit)
    if name == "entry_points":
        return entry_points(notes).limit(limit)
    return (unfiled if name == "unfiled" else orphans)(notes, links).orderBy("rel_path").limit(limit)


def two_hop(links: DataFrame, cid: str, towards: bool = True) -> DataFrame:
    """(cid): two links away, and neither one link away nor the note itself."""
    start, end = ("source_cid", "target_cid") if towards else ("target_cid", "source_cid")
    live = links.where(RESOLVED).select("source_cid", "target_cid")
    # written, so that its size is known: a small one is held against the tables that links are made of before anything is grouped
    near = _written(live.where(F.col(start) == cid).select(F.col(end).alias("near")).distinct())
    far = live.join(near, F.col(start) == F.col("near"), "left_semi").select(F.col(end).alias("cid")).distinct()
    return far.where(F.col("cid") != cid).join(near, F.col("cid") == F.col("near"), "left_anti")


#: A source's targets are paired in blocks of about so many, and a task makes about so many pairs.
PAIRED = 1000
PAIRS_A_TASK = 4_000_000


def _written(df: DataFrame) -> DataFrame:
    """The rows, made once: they are in the shared folder."""
    where = f"{shared_dir(df.sparkSession)}/marginalia/graph-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def _numbered(e: DataFrame, column: str) -> DataFrame:
    """name and number of a column's different values, written; numbers are in the order of the names."""
    names = e.select(F.col(column).alias("name")).distinct()
    return _written(names.repartitionByRange("name").sortWithinPartitions("name").withColumn("number", F.monotonically_increasing_id()))


def _work(rows: DataFrame, keys: list[str]) -> tuple[int, int]:
    """How many pairs the groups of rows make together, and the size of the largest."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.max("n").alias("most")).first()  # one row
    return int(n.pairs or 0), n.most or 0


def _pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, a and b for each two numbers (id) of a group of written rows, a < b.

    Groups whose least numbers are near come together, so that what is counted of them shrinks before
    it is shuffled.  A group of many makes a row for each two blocks of it, not one task for all its pairs.
    """
    pairs, most = _work(rows, keys)
    dealt = rows.withColumns({"_k": F.lit(1), "_b": F.lit(0)})
    if most > PAIRED:
        heavy = rows.groupBy(*keys).agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("_k")).where("_k > 1")
        dealt = rows.join(heavy, keys, "left").withColumn("_k", F.coalesce("_k", F.lit(1))).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int"))
    blocks = dealt.groupBy(*keys, "_k", "_b").agg(F.sort_array(F.collect_list("id")).alias("ids")).where("_k > 1 OR size(ids) > 1")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS_A_TASK))
    near = blocks.repartitionByRange(parts, F.get("ids", F.lit(0)))
    own = near.select(*keys, "ids", F.posexplode("ids").alias("_at", "a")).select(*keys, "a", F.explode(F.slice("ids", F.col("_at") + 2, F.size("ids"))).alias("b"))
    if most <= PAIRED:
        return own
    several = blocks.where("_k > 1")
    left = several.select(*keys, F.col("ids").alias("xs"), F.col("_b").alias("_i"), F.explode(F.sequence(F.col("_b"), F.col("_k") - 1)).alias("_j")).where("_i < _j")
    right = several.select(*keys, F.col("ids").alias("ys"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"), F.col("_b").alias("_j")).where("_i < _j")
    met = left.join(right, [*keys, "_i", "_j"]).select(*keys, "ys", F.explode("xs").alias("_x")).select(*keys, "_x", F.explode("ys").alias("_y"))
    return own.unionByName(met.select(*keys, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")))


def _shared(e: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, n): targets a < b that n >= least sources of written edges link together.

    All is counted over numbers; names come back to the result.  Where two sources in common are asked for and
    targets have far fewer sources than sources have targets, targets are paired that share a pair of sources:
    n sources in common are n(n - 1)/2 such pairs.
    """
    targets, sources = _numbered(e, "target_cid"), _numbered(e, "source_cid")
    number = lambda names, c, to: names.select(F.col("name").alias(c), F.col("number").alias(to))
    rows = _written(e.join(number(targets, "target_cid", "id"), "target_cid").join(number(sources, "source_cid", "k"), "source_cid").select("k", "id"))
    counted = None
    if least > 1:
        flipped = rows.select(F.col("id").alias("k"), F.col("k").alias("id"))
        direct = _work(rows, ["k"])[0]
        if 2 * _work(flipped, ["k"])[0] < direct:
            common = _written(_pairs(flipped, ["k"]).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("k").alias("id")))
            if 2 * _work(common, ["x", "y"])[0] < direct:
                twice = _pairs(common, ["x", "y"]).groupBy("a", "b").agg(F.count("*").alias("c"))
                counted = twice.select("a", "b", F.round((F.sqrt(F.col("c") * 8 + 1) + 1) / 2).cast("long").alias("n"))
    if counted is None:
        counted = _pairs(rows, ["k"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    name = lambda c: targets.select(F.col("number").alias(c), F.col("name").alias(f"_{c}"))
    return counted.where(F.col("n") >= least).join(name("a"), "a").join(name("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "n")


def co_citation(links: DataFrame, cid: str | None = None, least: int = 1) -> DataFrame:
    """(a, b, n): targets that n notes link together; of one target, or all pairs a < b."""
    if not cid:
        return _shared(_written(distinct_edges(links)), least)
    e = distinct_edges(links)
    left = e.where(F.col("target_cid") == cid).select("source_cid", F.col("target_cid").alias("a"))
    pairs = left.join(e.select("source_cid", F.col("target_cid").alias("b")), "source_cid").where("a != b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def coupling(links: DataFrame, cid: str | None = None, least: int = 1) -> DataFrame:
    """(a, b, n): notes that link n targets in common."""
    flipped = distinct_edges(links).select(F.col("target_cid").alias("source_cid"), F.col("source_cid").alias("target_cid"))
    return co_citation(flipped.withColumn("occurrences", F.lit(1)), cid, least)


def hub_degrees(hubs: DataFrame, links: DataFrame) -> DataFrame:
    """cid, outgoing, incoming of each hub, self links left out."""
    e = distinct_edges(links).where("source_cid != target_cid")
    out = e.groupBy(F.col("source_cid").alias("cid")).agg(F.count("*").alias("outgoing"))
    into = e.groupBy(F.col("target_cid").alias("cid")).agg(F.count("*").alias("incoming"))
    return hubs.select("cid").join(out, "cid", "left").join(into, "cid", "left").fillna(0, ["outgoing", "incoming"])


def _hub_pairs(hubs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """a, b, shared of hubs by their numbers; hubs (name, number and n, how many targets), and how many of them have a number."""
    names = hubs.select(F.col("cid").alias("name")).where("name IS NOT NULL").distinct()
    known, n = overlap.numbered(_written(names.repartitionByRange("name").sortWithinPartitions("name").withColumn("id", F.monotonically_increasing_id())))
    live = links.where(RESOLVED).where("source_cid != target_cid").select(F.col("source_cid").alias("name"), "target_cid")
    held = _written(overlap.lists(live.join(overlap.sent(known, n), "name")))
    sizes = held.select(F.explode("ids").alias("number")).groupBy("number").agg(F.count("*").alias("n"))
    return overlap.counted(held, n), _written(sizes.join(overlap.sent(known, n), "number")), n


def hub_overlap(hubs: DataFrame, links: DataFrame) -> DataFrame:
    """a, b, shared, smaller: hubs a < b that link common targets, and the lesser of their numbers of targets."""
    pairs, known, n = _hub_pairs(hubs, links)
    of = lambda c: overlap.sent(known.select(F.col("number").alias(c), F.col("name").alias(f"_{c}"), F.col("n").alias(f"n{c}")), n)
    return pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "shared", F.least("na", "nb").alias("smaller"))


def hub_overview(notes: DataFrame, links: DataFrame, limit: int = NEIGHBOURS, least_ratio: float = 0.0) -> DataFrame:
    """a, b, shared, smaller, ratio, total of pairs of hubs: most alike first, at most `limit`; total counts all of them.

    Each task keeps its first rows; numbers stand in the order of the names, which come to the result alone.
    """
    pairs, known, n = _hub_pairs(hubs(notes), links)
    of = lambda c: overlap.sent(known.select(F.col("number").alias(c), F.col("n").alias(f"n{c}")), n)
    sized = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("smaller", F.least("na", "nb"))
    first = _written(overlap.best(sized.withColumn("ratio", F.col("shared") / F.col("smaller")).where(F.col("ratio") >= least_ratio), limit))
    total = first.agg(F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"))
    named = F.broadcast(first.where("total IS NULL").drop("total").orderBy(F.desc("ratio"), F.desc("shared"), "a", "b").limit(limit))  # `limit` rows
    for c in "ab":
        named = F.broadcast(known.select(F.col("number").alias(c), F.col("name").alias(f"_{c}")).join(named, c))
    rows = named.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "shared", "smaller", "ratio").crossJoin(F.broadcast(total))  # one row
    return rows.orderBy(F.desc("ratio"), F.desc("shared"), "a", "b")


def resolve_targets(asked: DataFrame, cids: DataFrame) -> DataFrame:
    """target, cid, error, candidates, total of targets written by hand (target), all at once and by joins.

    A target is a path as it is, else the only path that differs from it in case, else a name as a
    wiki link has it, active notes before archived ones.  error: invalid (empty, absolute or with steps
    that climb), not_found, or ambiguous; then candidates are the first of all `total` notes that it could mean.
    """
    cids = cids.select("cid").distinct()
    text = F.trim(F.replace("target", F.lit("\\"), F.lit("/")))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\A(\./)+", ""), r"/+\z", ""), r"(?i)\.md\z", "")
    bad = path.startswith("/") | F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    inner = F.trim(F.regexp_replace(F.regexp_replace(path, r"\A\[\[|\]\]\z", ""), r"[|#].*\z", ""))
    rows = asked.select("target").distinct().withColumns({"_path": path, "_bad": F.coalesce(bad, F.lit(True)), "_name": F.regexp_replace(inner, r"(?i)\.md\z", "")})
    fine = rows.where("NOT _bad")
    exact = fine.join(cids, F.col("_path") == F.col("cid")).select("target", "cid", F.lit(0).alias("rule"))
    other = fine.join(cids.withColumn("_low", F.lower("cid")), F.lower("_path") == F.col("_low")).select("target", "cid", F.lit(1).alias("rule"))
    named = fine.where("_name <> ''").join(candidates(fine.select(F.col("_name").alias("name")), cids).withColumnRenamed("name", "_name"), "_name").select("target", "cid", F.lit(2).alias("rule"))
    hits = exact.unionByName(other).unionByName(named)
    # the first rule that answers decides
    best = hits.join(hits.groupBy("target").agg(F.min("rule").alias("rule")), ["target", "rule"])
    found = samples.least(best, ["target"], "cid", NEIGHBOURS)
    error = F.when(F.col("_bad"), "invalid").when(F.col("total") == 0, "not_found").when(F.col("total") > 1, "ambiguous")
    out = rows.join(found, "target", "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))
    return out.select("target", F.when(F.col("total") == 1, F.col("first")[0]).alias("cid"), error.alias("error"), F.when(F.col("total") > 1, F.col("first")).alias("candidates"), "total")


def resolve_cid(cids: DataFrame, target: str) -> str:
    """The cid that one target means (see `resolve_targets`); LookupError where nothing or more than one answers."""
    row = resolve_targets(cids.sparkSession.createDataFrame([(target,)], "target string"), cids).first()
    if row.error == "ambiguous":
        more = f" and {row.total - len(row.candidates)} more" if row.total > len(row.candidates) else ""
        raise LookupError(f"'{target}' means several notes: {', '.join(row.candidates)}{more}")
    if row.error:
        raise LookupError(f"no note '{target}'" if row.error == "not_found" else f"'{target}' is no path within the collection")
    return row.cid


def suggestions(names: DataFrame, target: str) -> DataFrame:
    """(cid): notes whose last segment is the target's, without regard to case or accents."""
    last = target.replace("\\", "/").rstrip("/").removesuffix(".md").rpartition("/")[2]
    return names.select("cid").distinct().where(folded(F.element_at(F.split("cid", "/"), -1)) == folded(F.lit(last))).orderBy("cid")


def reachable(start: DataFrame, links: DataFrame) -> DataFrame:
    """(cid): what forward links reach from `start` (cid), itself included, however far and through cycles.

    Edges are written once.  Every round goes HOPS links on and writes what it
    found new, each note once, with the hop that found it; the next starts from
    what its last hop found.  So plans stay short, lost executors cost one round,
    and only whether there is a next round comes to the driver.
    """
    spark = links.sparkSession
    where = f"{shared_dir(spark)}/marginalia/reach-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{where}/{name}")
        return spark.read.schema(df.schema).parquet(f"{where}/{name}")

    edges = kept(links.where(RESOLVED).where("source_cid != target_cid").select("source_cid", "target_cid"), "edges")  # the notes that a hop finds are made distinct, so links need not be
    frontier = seen = kept(start.select("cid").distinct().withColumn("hop", F.lit(HOPS)), "found/round=0")
    n = 0
    while not frontier.isEmpty():
        n += 1
        at, hops = frontier.select("cid"), []
        for hop in range(1, HOPS + 1):
            at = edges.join(at.withColumnRenamed("cid", "source_cid"), "source_cid", "left_semi").select(F.col("target_cid").alias("cid")).distinct()
            hops.append(at.withColumn("hop", F.lit(hop)))
        first = reduce(DataFrame.unionByName, hops).groupBy("cid").agg(F.min("hop").alias("hop"))
        frontier = kept(first.join(seen, "cid", "left_anti"), f"found/round={n}").where(F.col("hop") == HOPS)
        seen = spark.read.schema("cid string").parquet(f"{where}/found").select("cid")  # one scan, however many rounds
    return seen.select("cid")


#: Links that a round of `reachable` goes.
HOPS = 4


def hubs(notes: DataFrame) -> DataFrame:
    return notes.where("layer != 'archive' and type = 'moc' and parse_error is null")


def entry_points(notes: DataFrame) -> DataFrame:
    return hubs(notes).select("cid", "stem", "rel_path", "layer", "description").orderBy(F.col("layer") != "wiki", "stem", "cid")


ACTIVE = "coalesce(status, 'active') not in ('deprecated', 'abandoned')"


def unfiled(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Active wiki notes that no hub reaches."""
    listed = notes.where(f"layer = 'wiki' and parse_error is null and {ACTIVE}")
    return listed.join(reachable(hubs(notes), links), "cid", "left_anti").select("cid", "stem", "rel_path")


def orphans(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Notes of the wiki with no link either way; a dead link counts as one."""
    out = links.select(F.col("source_cid").alias("cid"))
    into = links.where(RESOLVED).select(F.col("target_cid").alias("cid"))
    return notes.where("layer = 'wiki'").join(out, "cid", "left_anti").join(into, "cid", "left_anti").select("cid", "rel_path")


def unprocessed_raw(raw: DataFrame, sources: DataFrame) -> DataFrame:
    cited = sources.where("resolved_path is not null").select(F.col("resolved_path").alias("rel_path"))
    return raw.select("rel_path").join(cited, "rel_path", "left_anti")


def raw_citers(notes: DataFrame, sources: DataFrame, path: str | None = None) -> DataFrame:
    found = sources.where(F.col("resolved_path") == path) if path else sources.where("resolved_path is not null")
    return found.select(F.col("source_cid").alias("cid"), "resolved_path").join(notes, "cid").select("cid", "resolved_path").distinct()
