"""Benchmark decontamination by winnowing.

Words of documents and items are hashed; k-grams of K words are hashed from
those; in every run of `WINDOW - K + 1` k-grams the smallest is kept (the last
of equals).  A span of WINDOW words that a document shares with an item holds
such a run, so both keep the same k-gram of it: no shared span of that length is
missed.  Document fingerprints are joined with the items' (sorted arrays, merged
in blocks), and each hit is extended to the windows around it, which are looked up by
their hash and compared word by word, so that a fingerprint that repeats in an item and in
a document costs no pairs.  Items shorter than WINDOW words are one window, matched by the hash of all their words.

The benchmark's fingerprints are broadcast in blocks of bounded size, one pass
over the documents for each block, one block held at a time; a small benchmark
is one block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, slices, table

WINDOW, K = 10, 5
#: Characters of benchmark text in a broadcast block.
BLOCK_CHARS = 16_000_000

_WORD_BYTE = np.ones(256, bool)
for _b in [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]:
    _WORD_BYTE[_b] = False
_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE_HASH = np.random.default_rng(20240).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes whose words are hashed at a time (a longer word makes a longer stretch).
STRETCH = 1 << 18


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.cumprod(np.full(n, x, np.uint64)) for x in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)))
    return up, down


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64; only the table for STRETCH bytes is kept."""
    if n > STRETCH + 1:
        return _power_table(n)
    if not _POWERS:
        _POWERS.append(_power_table(STRETCH + 1))
    up, down = _POWERS[0]
    return up[:n], down[:n]


@dataclass
class Words:
    raw: bytes  # lower case
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray  # of each word

    def same(self, a: int, b: int, other: Words, c: int, d: int) -> bool:
        """Whether words a to b here are c to d there, by their bytes."""
        return all(self.raw[s:e] == other.raw[t:f] for s, e, t, f in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), other.start[c:d].tolist(), other.end[c:d].tolist(), strict=True))


def words_of(text: str | None) -> Words:
    """Words and their 64-bit hashes, by prefix sums over the UTF-8 bytes."""
    raw = (text or "").encode("utf-8", "replace").lower()
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = _WORD_BYTE[b]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    hashes = np.zeros(len(start), np.uint64)
    first = 0
    while first < len(start):  # whole words that end within a stretch, one at least
        at = int(start[first])
        last = max(first + 1, int(np.searchsorted(end, at + STRETCH, side="right")))
        part, s, e = b[at : end[last - 1]], start[first:last] - at, end[first:last] - at
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_HASH[part] * up[: len(part)], out=sums[1:])
        hashes[first:last] = _mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        first = last
    return Words(raw, start, end, hashes)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return _mix(total + np.uint64(k))


def winnow(g: np.ndarray, run: int) -> np.ndarray:
    """Places of the smallest of every `run` neighbours, the last of equals."""
    if len(g) < run:
        return np.zeros(0, np.int64)
    n = len(g) - run + 1
    best, place = g[:n].copy(), np.arange(n)
    for j in range(1, run):
        here = g[j : j + n]
        less = here <= best
        best = np.where(less, here, best)
        place = np.where(less, np.arange(j, j + n), place)
    return np.unique(place)


@dataclass
class Index:
    """A block of items: their fingerprints, and every window's hash with an item that has it and where."""

    items: list[tuple[str, Words]]
    prints: np.ndarray  # sorted
    window: np.ndarray  # sorted; an item's equal windows are one
    item: np.ndarray
    at: np.ndarray
    short: dict[int, dict[int, list[int]]]  # by number of words: hash, items

    @staticmethod
    def of(rows: list[tuple[str, str | None]]) -> Index:
        items = [(i, words_of(t)) for i, t in rows]
        prints, windows, owners, places, short = [], [], [], [], {}
        for k, (_, w) in enumerate(items):
            n = len(w.hash)
            if 0 < n < WINDOW:
                short.setdefault(n, {}).setdefault(int(grams(w.hash, n)[0]), []).append(k)
            elif n:
                g = grams(w.hash, K)
                prints.append(np.unique(g[winnow(g, WINDOW - K + 1)]))
                own, first = np.unique(grams(w.hash, WINDOW), return_index=True)
                windows.append(own)
                places.append(first)
                owners.append(np.full(len(own), k))
        if not prints:
            none = np.zeros(0, np.int64)
            return Index(items, none.astype(np.uint64), none.astype(np.uint64), none, none, short)
        h, o, p = np.concatenate(windows), np.concatenate(owners), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        return Index(items, np.unique(np.concatenate(prints)), h[order], o[order], p[order], short)

    def hits(self, doc: Words) -> tuple[np.ndarray, set[int]]:
        """Which words of a document are hit, and by which items.

        Every window holds one of the document's fingerprints, and a shared one an item's too.  So around each
        fingerprint that an item has, the windows that hold it are looked up; each is compared once.
        """
        n = len(doc.hash)
        hit, found = np.zeros(n + 1, np.int64), set()
        g = grams(doc.hash, K)
        place = winnow(g, WINDOW - K + 1)
        if len(place) and len(self.prints):
            at = np.searchsorted(self.prints, g[place])
            place = place[(at < len(self.prints)) & (self.prints[np.minimum(at, len(self.prints) - 1)] == g[place])]
            near = np.zeros(n + 1, np.int64)
            np.add.at(near, np.maximum(place - (WINDOW - K), 0), 1)
            np.add.at(near, np.minimum(place, n - WINDOW) + 1, -1)
            starts = np.flatnonzero(np.cumsum(near)[: n - WINDOW + 1])
            if len(starts):
                w = grams(doc.hash, WINDOW)[starts]
                lo, hi = np.searchsorted(self.window, w), np.searchsorted(self.window, w, side="right")
                met: dict[int, int] = {}  # by place in the index: where a window was that an item has
                for i in np.flatnonzero(hi > lo).tolist():
                    p, first = int(starts[i]), int(lo[i])
                    if first not in met or not doc.same(p, p + WINDOW, doc, met[first], met[first] + WINDOW):
                        own = [(int(self.item[r]), int(self.at[r])) for r in range(first, int(hi[i]))]
                        same = [k for k, c in own if doc.same(p, p + WINDOW, self.items[k][1], c, c + WINDOW)]
                        if not same:
                            continue
                        found.update(same)
                        met.setdefault(first, p)
                    hit[p] += 1
                    hit[p + WINDOW] -= 1
        for size, known in self.short.items():
            g = grams(doc.hash, size)
            for p in np.flatnonzero(np.isin(g, np.fromiter(known, np.uint64, len(known)))).tolist():
                for k in known[int(g[p])]:
                    if doc.same(p, p + size, self.items[k][1], 0, size):
                        hit[p] += 1
                        hit[p + size] -= 1
                        found.add(k)
        return np.cumsum(hit)[:n] > 0, found


_HELD: list = []


def index_of(rows: list[tuple[str, str | None]]) -> Index:
    """A block's index, built once in each Python worker."""
    if not _HELD or _HELD[0] is not rows:
        _HELD[:] = [rows, Index.of(rows)]
    return _HELD[1]


def _blocks(items: DataFrame, chars: int = BLOCK_CHARS) -> tuple[int, Iterator[list[tuple[str, str | None]]]]:
    """How many blocks of about `chars` characters the items make, and the blocks."""
    total = items.agg(F.sum(F.length("text") + 16).alias("n")).first().n or 0
    blocks = max(1, -(-total // chars))

    def each() -> Iterator[list[tuple[str, str | None]]]:
        for b in range(blocks):
            part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
            yield sorted((r.item_id, r.text) for r in part.collect())

    return blocks, each()


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row.

    Null and empty texts have no words.  Items without words have no window; a
    null item_id is one item, whose id is empty.  Repeated items count once, as
    item_id.  Repeated rows each give a row, and a null doc_id stays null.  Empty
    documents give no rows; an empty benchmark hits nothing.  Only doc_id and
    text, item_id and text are read, so other columns may have any name.
    """
    n, blocks = _blocks(_items(benchmark), block_chars)
    if n == 1:
        found, _ = _pass(docs, next(blocks))
    else:  # a row of a document is known by its place in a written table
        rows = materialize(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")), "decontaminate")
        every = None
        for block in blocks:
            part, shared = _pass(rows, block, "_row")
            part = materialize(part.where("n_hit > 0") if every is not None else part, "decontaminate-part")
            shared.destroy()
            every = part if every is None else every.unionByName(part)
        found = every.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).drop("_row")
        merged = F.aggregate(F.array_sort("runs"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(r["start"], s["end"]))).alias("n"), F.greatest(s["end"], r["end"]).alias("end")))["n"]
        found = found.withColumn("n_hit", merged)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _pass(docs: DataFrame, rows: list[tuple[str, str | None]], key: str | None = None) -> tuple[DataFrame, Broadcast]:
    """What one block of items hits, and the block as the executors hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), *([("_row", pa.int64())] if key else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(shared.value)
        for batch in slices(batches, 1):
            out: tuple[list, ...] = ([], [], [], [])
            for text in batch.column(1).to_pylist():
                doc = words_of(text)
                hit, found = index.hits(doc)
                edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
                begin, end = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()
                out[0].append(len(doc.hash))
                out[1].append(int(hit.sum()))
                out[2].append([{"start": a, "end": b} for a, b in zip(begin, end, strict=True)])
                out[3].append(sorted({index.items[k][0] for k in found}))
            columns = [batch.column(0), *(pa.array(c, schema.field(i + 1).type) for i, c in enumerate(out)), *([batch.column(2)] if key else [])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    names = [F.col("doc_id").cast("long"), F.col("text"), *([F.col(key)] if key else [])]
    return docs.select(*names).mapInArrow(run, "doc_id long, n_words long, n_hit long, runs array<struct<start: long, end: long>>, items array<string>" + (", _row long" if key else "")), shared


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every item.  See `contamination`."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_GRAM = {n: " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER w" for k in range(1, n))]) for n in range(1, WINDOW + 1)}
#: The same over the tables documents and benchmark, for DuckDB.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_, doc_id, coalesce({_WORDS.format("text")}, []) AS words FROM documents),
i AS (SELECT coalesce(item_id::varchar, '') AS item_id, {_WORDS.format("text")} AS words FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(len(words), {WINDOW}) AS size, unnest(list_transform(range(1, len(words) - least(len(words), {WINDOW}) + 2), lambda p: array_to_string(words[p:p + {WINDOW - 1}], ' '))) AS gram FROM i WHERE len(words) > 0),
placed AS (SELECT row_, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
grams AS ({" UNION ALL ".join(f"SELECT row_, p, {n} AS size, {_GRAM[n]} AS gram FROM placed WHERE {n} IN (SELECT size FROM windows) WINDOW w AS (PARTITION BY row_ ORDER BY p)" for n in _GRAM)}),
hits AS (SELECT row_, p, size, item_id FROM grams JOIN windows USING (size, gram)),
counted AS (SELECT row_, count(DISTINCT place) AS n_hit FROM (SELECT row_, unnest(range(p, p + size)) AS place FROM hits) x GROUP BY row_),
named AS (SELECT row_, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT row_, item_id FROM hits) x GROUP BY row_)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN counted USING (row_) LEFT JOIN named USING (row_)
"""


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that share a window with an item go; the others keep all columns.

    Null and empty texts stay; an empty benchmark takes nothing.
    """
    n, blocks = _blocks(_items(table(spark, sf_dir, "benchmark")))
    at = docs.columns.index("text")
    kept = docs
    for k, rows in enumerate(blocks):
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = index_of(shared.value)
            for batch in slices(batches, at):
                yield batch.filter(pa.array([not index.hits(words_of(t))[1] for t in batch.column(at).to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
        if k + 1 < n:
            kept = materialize(kept, "decontaminate-kept")
            shared.destroy()
    return kept
