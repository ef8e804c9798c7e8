"""Merkle manifest of a table: one trie of hashes for each group of rows, and one over the groups.

A leaf's place is its rank by id within its group.  Ranks come from histograms,
not from a sort of the table: an id is a string of digits, rows are counted by
all its digits, those counts by all digits but the last, and so on; a rank is the
sum of what lies before it at each step, and each window spans at most 256
counts.  Rows that share an id go on by the digits of their leaf, and equal rows are
counted, so neither a frequent id nor a frequent row stands in one task.

The rank, written in digits of base `fanout`, is the key of the leaf in a trie: nodes
of one prefix hash to the node of that prefix.  Spark reduces `depth` digits at
once, a chunk of at most fanout ** depth nodes for each prefix, so a table of n
rows takes log(n) / (depth * log(fanout)) shuffles of hashes.  The
sibling hashes of every leaf are read from the same chunks, from the top down.

Rules: a null field is `-`; null groups form one group, ordered first; null ids
come first in their group; rows with one id are ordered by leaf, and equal rows take
places side by side, each with its own proof.  An empty table has no rows, so no root.
Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, DEPTH = 2, 10
#: Bits of a digit of an id: a window spans at most 2 ** BITS counts.
BITS = 8
#: Equal rows are written out in runs of so many.
RUN = 1024


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(rows: DataFrame, id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, **more: Column) -> DataFrame:
    """tree, id, leaf, and the columns `more`.  tree: the group after `=`, empty where it is null, so that null is first by bytes."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    return rows.select(tree.alias("tree"), F.col(id).cast("long").alias("id"), digest(*[field(F.col(c)) for c in fields]).alias("leaf"), *[c.alias(name) for name, c in more.items()])


def starts(counts: DataFrame, group: list[str], digits: list[str]) -> DataFrame:
    """counts: one row with a count `n` for each (group, digits).  Adds `start`, the sum of n over all smaller digits of the group."""
    *above, last = digits
    here = F.sum("n").over(W.partitionBy(*group, *above).orderBy(last)) - F.col("n")
    if not above:
        return counts.withColumn("start", here)
    upper = starts(counts.groupBy(*group, *above).agg(F.sum("n").alias("n")), group, above)
    upper = upper.select(*group, *above, F.col("start").alias("before"))
    return counts.withColumn("here", here).join(upper, [*group, *above]).withColumn("start", F.col("before") + F.col("here")).drop("before", "here")


def _id_digits(ids: DataFrame) -> dict[str, Column]:
    """The digits in which ids differ, highest first; a digit for null ids stands before them."""
    low, high, nulls = ids.agg(F.min("id"), F.max("id"), F.count_if(F.col("id").isNull())).first()
    found = {"d": F.col("id").isNotNull().cast("long")} if nulls else {}
    if low is None:
        return found or {"d": F.lit(0).cast("long")}
    differ = 64 if (low < 0) != (high < 0) else (low ^ high).bit_length()
    depth = max(1, -(-differ // BITS))
    for i in reversed(range(depth)):
        digit = F.shiftright("id", BITS * i)
        found[f"d{i}"] = F.coalesce(digit if i == depth - 1 else digit.bitwiseAND((1 << BITS) - 1), F.lit(0)).cast("long")
    return found


def ranked(rows: DataFrame) -> DataFrame:
    """leaves() with `rank` from 0 by (id, leaf) within the tree, and `size`, the rows of the tree."""
    more = [c for c in rows.columns if c not in ("tree", "id", "leaf")]
    rows = materialize(rows, "merkle-leaves")
    digits = _id_digits(rows)
    rows = rows.withColumns(digits)
    names = ["tree", *digits]
    counts = materialize(rows.groupBy(*names).agg(F.count("*").alias("n"), F.min(F.struct("id", "leaf", *more)).alias("row")), "merkle-counts")
    placed = starts(counts, ["tree"], list(digits))
    found = placed.where("n = 1").select("tree", "row.*", F.col("start").alias("rank"))
    if not counts.where("n > 1").isEmpty():
        shared = placed.where("n > 1").select(*names, F.col("start").alias("first"))
        equal = rows.join(shared, names).groupBy(*names, "first", "id", "leaf", *more).agg(F.count("*").alias("n"))
        bytes_of = {f"b{i}": F.substring("leaf", 2 * i + 1, 2) for i in range(3)}
        equal = starts(materialize(equal.withColumns(bytes_of), "merkle-equal"), [*names, "first"], [*bytes_of, "leaf"])
        runs = equal.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
        runs = runs.repartition("tree", "id", "leaf", "run")
        each = runs.withColumn("place", F.explode(F.sequence("run", F.least(F.col("run") + RUN, F.col("n")) - 1)))
        found = found.unionByName(each.select("tree", "id", "leaf", *more, (F.col("first") + F.col("start") + F.col("place")).alias("rank")))
    return found.join(counts.groupBy("tree").agg(F.sum("n").alias("size")), "tree")


@dataclass
class Trie:
    """Chunk tables from the leaves up: tree, size, chunk, items (rank, hash and what else a node carries, by rank), height, levels (their hashes, then those above)."""

    layers: list[DataFrame]
    fanout: int
    depth: int

    def tops(self) -> DataFrame:
        """tree, hash: the last node of each."""
        return self.layers[-1].select("tree", F.expr("element_at(levels, -1)[0]").alias("hash"))

    def paths(self) -> DataFrame:
        """Each leaf's columns and `path`: from its run up, the hashes before and after it in the run, joined as text."""
        above = None
        width, powers = self.fanout**self.depth, ", ".join(f"{self.fanout**i}L" for i in range(self.depth))
        place = f"((i.rank % {width}L) div array({powers})[l])"
        first = f"({place} - {place} % {self.fanout})"
        before = f"array_join(slice(levels[l], cast({first} + 1 as int), cast({place} % {self.fanout} as int)), '')"
        after = f"array_join(slice(levels[l], cast({place} + 2 as int), cast({self.fanout - 1} - {place} % {self.fanout} as int)), '')"
        own = f"transform(slice(sequence(0, {self.depth - 1}), 1, height), l -> struct({before} as before, {after} as after))"
        for chunks in reversed(self.layers):
            names = [f.name for f in chunks.schema["items"].dataType.elementType.fields]
            rows, path = (chunks, own) if above is None else (chunks.join(above, ["tree", "chunk"]), f"concat({own}, path)")
            rows = rows.select("tree", "size", F.expr(f"inline(transform(items, i -> struct({', '.join(f'i.{n}' for n in names)}, {path} as path)))"))
            above = rows.select("tree", F.col("rank").alias("chunk"), "path")
        return rows


def trie(nodes: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> Trie:
    """nodes: tree, size (its leaves), rank, hash, and what else a leaf carries."""
    width = fanout**depth
    largest = nodes.agg(F.max("size")).first()[0] or 0
    more = [c for c in nodes.columns if c not in ("tree", "size", "rank", "hash")]
    above = f"transform(sequence(0, (size(last) - 1) div {fanout}), i -> sha2(array_join(slice(last, cast(i * {fanout} + 1 as int), {fanout}), ''), 256))"
    # the list of levels, with the one above the last
    grow = f"aggregate(slice(sequence(1, {depth}), 1, height), array(items.hash), (levels, _) -> concat(levels, transform(array(element_at(levels, -1)), last -> {above})))"
    layers = []
    while True:
        chunks = nodes.groupBy("tree", "size", F.expr(f"rank div {width}L").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("rank", "hash", *more))).alias("items"))
        # levels while several nodes of the tree remain
        height = sum((F.when(F.col("size") > fanout**i, 1).otherwise(0) for i in range(1, depth)), F.when(F.col("size") > 1, 1).otherwise(0))
        layers.append(materialize(chunks.withColumn("height", height).withColumn("levels", F.expr(grow)), "merkle-chunks"))
        if largest <= width:
            return Trie(layers, fanout, depth)
        largest, more = (largest - 1) // width + 1, []
        nodes = layers[-1].select("tree", F.expr(f"(size - 1) div {width}L + 1").alias("size"), F.col("chunk").alias("rank"), F.expr("element_at(levels, -1)[0]").alias("hash"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(proof, leaf, lambda h, run: digest(run["before"], h, run["after"]))


def proofs(rows: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """leaves() to tree, id, leaf, its other columns, rank, subroot, root and proof (the path to the root: arrays of before and after)."""
    leaf = ranked(rows).withColumnRenamed("leaf", "hash")
    own = trie(leaf, fanout, depth)
    # a row for each group: their order takes one small sort
    tops = materialize(own.tops(), "merkle-subroots")
    groups = tops.withColumns({"size": F.count("*").over(W.partitionBy()), "rank": F.row_number().over(W.orderBy("tree")).cast("long") - 1})
    over = trie(groups.select(F.lit("").alias("tree"), "size", "rank", "hash", F.col("tree").alias("member")), fanout, depth)
    root = over.tops().select(F.lit("").alias("tree"), F.col("hash").alias("root"))
    whole = over.paths().join(root, "tree").select(F.col("member").alias("tree"), F.col("hash").alias("subroot"), "root", F.col("path").alias("rest"))
    found = own.paths().join(materialize(whole, "merkle-groups"), "tree")
    return found.withColumn("proof", F.concat("path", "rest")).withColumnRenamed("hash", "leaf").drop("path", "rest", "size")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's leaf, proof and the root that the proof gives for the leaf, or for that of a tampered row."""
    docs = table(spark, sf_dir, "documents")
    one_more = F.col("n_chars").cast("decimal(20,0)") + 1
    altered = digest(*[field(one_more.cast("decimal(20,0)") if c == "n_chars" else F.col(c)) for c in FIELDS])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = leaves(docs, shown=F.when(tampered, altered))
    found = proofs(rows).withColumn("folded_root", fold(F.coalesce("shown", "leaf"), F.col("proof")))
    siblings = F.transform("proof", lambda run: F.concat(run["before"], run["after"]))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = """
WITH RECURSIVE
fields AS (
  SELECT doc_id, lang, n_chars, crc.c % 7 = 0 AS tampered,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents, LATERAL (SELECT xor(list_reduce(
    list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT),
    lambda h, byte: list_reduce([xor(h, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, zero: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END),
    4294967295), 4294967295) AS c) crc
),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS shown,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size
  FROM fields
),
nodes AS (
  SELECT lang, 0 AS level, place, size, leaf AS hash FROM leaves
  UNION ALL
  SELECT lang, any_value(level) + 1, place // 2, (any_value(size) + 1) // 2, sha256(string_agg(hash, '' ORDER BY place)) FROM nodes WHERE size > 1 GROUP BY lang, place // 2
),
subroots AS (SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM nodes WHERE size = 1),
upper_nodes AS (
  SELECT 0 AS level, place, size, subroot AS hash FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, place // 2, (any_value(size) + 1) // 2, sha256(string_agg(hash, '' ORDER BY place)) FROM upper_nodes WHERE size > 1 GROUP BY place // 2
),
steps AS (
  SELECT doc_id, n.level, n.place % 2 = 0 AS after, n.hash FROM leaves l JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.place = xor(l.place // (1::BIGINT << n.level), 1)
  UNION ALL
  SELECT doc_id, 1000 + n.level, n.place % 2 = 0, n.hash FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN upper_nodes n ON n.place = xor(s.place // (1::BIGINT << n.level), 1)
),
levels AS (
  SELECT DISTINCT lang, level FROM nodes WHERE size > 1
  UNION ALL
  SELECT s.lang, 1000 + u.level FROM subroots s, (SELECT DISTINCT level FROM upper_nodes WHERE size > 1) u
),
walk AS (
  SELECT l.doc_id, l.leaf, l.shown, list(struct_pack(after := s.after, hash := coalesce(s.hash, '')) ORDER BY v.level) FILTER (v.level IS NOT NULL) AS path,
    l.lang
  FROM leaves l LEFT JOIN levels v ON v.lang IS NOT DISTINCT FROM l.lang LEFT JOIN steps s ON s.doc_id = l.doc_id AND s.level = v.level
  GROUP BY ALL
),
folds AS (
  SELECT doc_id, coalesce(shown, leaf) AS hash, 1 AS k, coalesce(len(path), 0) AS n, path FROM walk
  UNION ALL
  SELECT doc_id, sha256(CASE WHEN path[k].after THEN path[k].hash || hash ELSE hash || path[k].hash END), k + 1, n, path FROM folds WHERE k <= n
),
root AS (SELECT hash AS root FROM upper_nodes WHERE size = 1)
SELECT w.doc_id, w.leaf, s.subroot, r.root, sha256(coalesce(array_to_string(list_transform(w.path, lambda x: x.hash), ''), '')) AS proof_sha256,
  f.hash AS folded_root, f.hash = r.root AS verified
FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang JOIN folds f ON f.doc_id = w.doc_id AND f.k > f.n, root r
"""
