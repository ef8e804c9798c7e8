"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits are split into 4 blocks of 16.  Two that differ in at
most 2 bits agree in at least 2 blocks, so every close pair shares one of the 6
keys (which two blocks, their 32 bits).  Fingerprints are joined on keys and the
Hamming distance is verified.  Equal fingerprints are one row from the start.

A key with more than `SMALL` different fingerprints is not paired up: in it, the
other 32 bits differ in at most 2 places, so each fingerprint is listed under
itself and its 32 one-bit changes there; two that are close share such a
neighbour, and all that share one are close to one another.  Linking each to the
smallest of them loses no component and makes 33 rows for a fingerprint,
however large the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.common import materialize, slices, table
from marginalia.llm.components import connected

SEED = 42
WORDS = 3
DISTANCE = 2
SMALL = 8
#: A fingerprint with more than one in so many of all rows is joined by broadcast: there are no more than HOT of them.
HOT = 100
PAIRS = list(combinations(range(4), 2))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits over the XXH64 of every shingle, repeats included; 0 without words."""
    import xxhash

    raw = (text or "").encode("utf-8", "replace")
    total, n = np.zeros(64, np.int64), 0
    parts = raw.lower().split()  # ASCII letters and white space alone
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        bounds = [(0, len(line))]
    else:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        starts = np.cumsum(sizes) - sizes
        ends = starts + sizes - 1
        bounds = list(zip(starts[: -words + 1].tolist(), ends[words - 1 :].tolist(), strict=True))
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(bounds), 65536):
        h = np.array([digest(line[a:b], SEED) for a, b in bounds[i : i + 65536]], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def _prints(rows: DataFrame, words: int) -> DataFrame:
    """Puts fp in place of text, which is the last column."""
    at = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            fps = np.array([fingerprint(t, words) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=[*batch.schema.names[:-1], "fp"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row; null and empty texts: 0."""
    return _prints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words)


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): close pairs of different fingerprints, enough of them to connect all that are connected.

    `fps` has a distinct column fp.
    """
    assert 0 < distance <= 2, "four blocks guarantee two shared ones up to two differing bits"

    def block(i: int) -> F.Column:
        return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))

    keys = F.array(*[F.struct(F.lit(k).alias("k"), (F.shiftleft(block(i), 16).bitwiseOR(block(j))).alias("v")) for k, (i, j) in enumerate(PAIRS)])
    keyed = materialize(fps.select("fp", F.explode(keys).alias("x")).select("fp", F.col("x.k").alias("k"), F.col("x.v").alias("v")), "simhash-keys")
    counted = keyed.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(counted, ["k", "v"]), "simhash-shared")  # keys of several fingerprints only
    small = shared.where(F.col("n") <= SMALL)
    left, right = small.select("k", "v", F.col("fp").alias("a")), small.select("k", "v", F.col("fp").alias("b"))
    pairs = left.join(right, ["k", "v"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    # bits outside the key's two blocks
    free = F.lit(None)
    for k, (i, j) in enumerate(PAIRS):
        bits = [b for blk in range(4) if blk not in (i, j) for b in range(16 * blk, 16 * blk + 16)]
        free = F.when(F.col("k") == k, F.array(*[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long") for b in bits])).otherwise(free)
    near = F.concat(F.array(F.lit(0).cast("long")), free)
    large = shared.where(F.col("n") > SMALL).select("k", "v", "fp", F.explode(near).alias("bit")).select("k", "v", "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("near"))
    if distance == 1:  # the fingerprints themselves must be one step from the shared neighbour
        large = large.withColumn("own", F.col("fp") == F.col("near"))
    centre = large.groupBy("k", "v", "near").agg(F.min("fp").alias("a"), F.count("*").alias("m")).where("m > 1").drop("m")
    stars = large.join(centre, ["k", "v", "near"]).where((F.col("a") != F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= distance)).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.

    Null and empty texts share fingerprint zero.  Rows without doc_id are kept
    and can link others; a component of such rows alone has a null id.  Repeated
    rows each give a row.  An empty table gives no rows.  Only doc_id and text
    are read, so other columns may have any name.
    """
    prints = materialize(fingerprints(docs, words), "simhash")
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    found = connected(links(reps.select("fp"), distance))  # fp, root: those with links only
    linked = materialize(reps.join(found, "fp").select("fp", "root", "low"), "simhash-linked")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = materialize(reps.join(linked.join(lowest, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"), "n"), "simhash-groups")
    # fingerprints of more than a hundredth of all rows, of which there are a hundred at most, meet their rows without a shuffle
    rows = of_fp.agg(F.sum("n").alias("n")).first().n or 0
    hot = F.broadcast(of_fp.where(F.col("n") > rows / HOT).drop("n"))
    rest = prints.join(hot.select("fp"), "fp", "left_anti").join(of_fp.where(F.col("n") <= rows / HOT).drop("n"), "fp")
    every = prints.join(hot, "fp").unionByName(rest)
    return every.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document.  See `components` for nulls, repeated rows and empty tables."""
    return components(table(spark, sf_dir, "documents"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the row with the smallest doc_id stays, once.

    Rows are told apart by doc_id and text: different texts under one doc_id are
    rows of their own, of which the first by the text's hash stays where they are
    near duplicates.  A row without doc_id comes after those with one.  Null and
    empty texts are near duplicates of one another.  An empty table gives no rows.
    """
    mark = F.sha2("text", 256)
    prints = materialize(_prints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("_mark"), "text"), WORDS), "simhash-rows")
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_mark")).alias("first"))
    found = connected(links(first.select("fp"), DISTANCE))
    keep = first.join(found, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first._mark").alias("_kept"))
    marked = docs.withColumn("_mark", mark)
    kept = marked.join(keep, marked["doc_id"].cast("long").eqNullSafe(keep["_id"]) & marked["_mark"].eqNullSafe(keep["_kept"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_mark"]).select(*docs.columns)
