"""Exact top-k by integer inner product: vectors in order of falling length, rotated partial sums, bounds on the rest.

All rows are written once as shards of bounded size, in order of falling length,
each with the basis that the SVD of its own vectors gives (leading directions hold
most of their length).  Queries are written once as blocks of bounded size.

A pair of a shard and a block goes through the shard by falling length.  A query is done when its
length times that of the next vector is below its k-th best score (Cauchy-Schwarz
on whole vectors).  Otherwise it is multiplied with the leading directions alone;
what the others can add is at most the product of both remainders' lengths, and only
pairs whose bound reaches the k-th best score are multiplied out, in integers.

Every block first meets the shard of the longest vectors.  That gives each query a
score to beat, and a block meets only those further shards whose longest vector can still
reach it for one of its queries.  Pairs are rows that Spark deals out; a task
holds one at a time, and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, table

SCALE = 64
SHARD_BYTES = 4_000_000
BLOCK_BYTES = 4_000_000
#: Share of the squared length that the leading directions should hold.
LEADING = 0.7
#: Bounds allow for rounding of so much of the product of both lengths.
SLACK = 1e-9
#: Scores and components beyond are cut to this: the ends of a long.
END = 2**63 - 1


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of every component, as long.

    Null vectors, those that hold a null or a component that isn't finite, and rows
    without a key take no part; zero and empty vectors do.  Repeated rows stay.
    Components beyond a long are cut to its ends.  Other columns aren't read.
    """
    v = F.col(column).cast("array<double>")
    fine = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    whole = f"transform(v, x -> cast(greatest(least(floor(cast({scale} as double) * x), {END}L), -{END}L) as bigint))"
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(fine).select("id", F.expr(whole).alias("v"))


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(components, ids, vectors): runs of rows with equally many components, of about `size` bytes."""

    def whole() -> tuple[int, np.ndarray, np.ndarray]:
        return d, np.concatenate(ids), np.concatenate(vectors)

    d, ids, vectors, held = -1, [], [], 0
    for batch in batches:
        column = batch.column("v")
        lens = np.diff(column.offsets.to_numpy())
        own, flat = batch.column("id").to_numpy(), column.flatten().to_numpy()
        ends = np.cumsum(lens)
        for run in np.split(np.arange(len(lens)), np.flatnonzero(np.diff(lens)) + 1) if len(lens) else []:
            n = int(lens[run[0]])
            at = 0
            while at < len(run):
                if ids and (n != d or held >= size):
                    yield whole()
                    ids, vectors, held = [], [], 0
                d, take = n, run[at : at + max(1, -(-(size - held) // (8 * max(n, 1))))]
                ids.append(own[take])
                vectors.append(flat[ends[take[0]] - n : ends[take[-1]]].reshape(len(take), n))
                held += len(take) * 8 * max(n, 1)
                at += len(take)
    if ids:
        yield whole()


def _written(rows: DataFrame, name: str, size: int, turned: bool = True) -> DataFrame:
    """d, part, longest, ids, vectors, basis: parts of bounded size, in the order of `rows` within its partitions.

    The basis is empty where it isn't asked for, or would be larger than a quarter of the vectors.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for i, (d, ids, v) in enumerate(_parts(batches, size)):
            x = v.astype(np.float64)
            basis = np.linalg.eigh(x.T @ x)[1][:, ::-1] if turned and 0 < 4 * d <= len(x) else np.zeros((0, 0))
            longest = float(np.sqrt((x**2).sum(axis=1).max()))
            yield pa.RecordBatch.from_pydict({"d": [d], "part": [base + i], "longest": [longest], "ids": [ids.tobytes()], "vectors": [v.tobytes()], "basis": [np.ascontiguousarray(basis).tobytes()]}, schema)

    schema = pa.schema([("d", pa.int32()), ("part", pa.int64()), ("longest", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("basis", pa.binary())])
    return materialize(rows.mapInArrow(build, "d int, part long, longest double, ids binary, vectors binary, basis binary"), name)


class Shard:
    """Vectors in order of falling length, with the shard's rotation."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, basis: np.ndarray):
        self.ids, self.whole = ids, vectors
        self.x = vectors.astype(np.float64)
        self.basis = basis
        turned = self.turned(self.x)
        power = (turned**2).sum(axis=0)
        self.leading = int(np.searchsorted(np.cumsum(power), LEADING * power.sum())) + 1
        self.front = turned[:, : self.leading]
        self.rest = np.sqrt((turned[:, self.leading :] ** 2).sum(axis=1))
        self.length = np.sqrt((self.x**2).sum(axis=1))
        self.most = float(np.abs(self.x).max(initial=0))

    def turned(self, x: np.ndarray) -> np.ndarray:
        return x @ self.basis if self.basis.size else x

    def products(self, q: np.ndarray, rows: slice | np.ndarray, paired: bool) -> np.ndarray:
        """Exact inner products of integer vectors, of each with each or paired row by row."""
        v = self.x[rows]
        if self.x.shape[1] * self.most * float(np.abs(q).max(initial=0)) < 2**53:  # every partial sum is a whole double
            x = q.astype(np.float64)
            return (np.einsum("ij,ij->i", x, v) if paired else x @ v.T).astype(np.int64)
        a, b = q.astype(object), self.whole[rows].astype(object)
        exact = (a * b).sum(axis=1) if paired else a @ b.T
        return np.clip(exact, -END, END).astype(np.int64)

    def best(self, qids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query's place, id, score) of all that can be among the k best of each query, and the number multiplied out.

        least: what a score must reach; it is raised in place to the k-th best met.
        """
        x = q.astype(np.float64)
        length = np.sqrt((x**2).sum(axis=1))
        turned = self.turned(x)
        front, rest = turned[:, : self.leading], np.sqrt((turned[:, self.leading :] ** 2).sum(axis=1))
        who, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step, out = 0, 64, 0
        while at < len(self.ids):
            live = np.flatnonzero(length * self.length[at] * (1 + SLACK) >= least)
            if not len(live):
                break
            span = slice(at, at + step)
            bound = front[live] @ self.front[span].T + rest[live][:, None] * self.rest[span] + SLACK * length[live][:, None] * self.length[span]
            hit = (bound >= least[live][:, None]) & (qids[live][:, None] != self.ids[span])
            a, b = np.nonzero(hit)
            out += len(a)
            if len(a) > 0.1 * hit.size:
                got = self.products(q[live], span, False)[a, b]
            else:
                got = np.concatenate([np.zeros(0, np.int64), *(self.products(q[live[a[i : i + 65536]]], at + b[i : i + 65536], True) for i in range(0, len(a), 65536))])
            keep = got >= least[live[a]]
            who, ids, scores = np.concatenate([who, live[a[keep]]]), np.concatenate([ids, self.ids[span][b[keep]]]), np.concatenate([scores, got[keep]])
            order = np.lexsort((ids, -scores, who))
            who, ids, scores = who[order], ids[order], scores[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            last = place == k - 1
            # below a score that a double can't hold exactly
            least[who[last]] = np.maximum(least[who[last]], np.where(np.abs(scores[last]) < 2**53, scores[last], np.nextafter(scores[last].astype(np.float64), -np.inf)))
            keep = place < k
            who, ids, scores = who[keep], ids[keep], scores[keep]
            at, step = at + step, min(2 * step, 4096)
        return who, ids, scores, out


BATCH = 512


def _meet(row, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A pair's (query's place in its block, id, score), with `least` raised."""
    ids, qids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.qids, np.int64)
    shard = Shard(ids, np.frombuffer(row.vectors, np.int64).reshape(len(ids), row.d), np.frombuffer(row.basis).reshape(-1, max(row.d, 1)))
    q = np.frombuffer(row.queries, np.int64).reshape(len(qids), row.d)
    found = [(np.zeros(0, np.int64),) * 3]
    for i in range(0, len(qids), BATCH):
        who, near, scores, _ = shard.best(qids[i : i + BATCH], q[i : i + BATCH], least[i : i + BATCH], k)
        found.append((who + i, near, scores))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


FOUND = "query_id long, block long, place long, vec_id long, score long"


def search(rows: DataFrame, queries: DataFrame, k: int = 20, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (id, v) the k rows (id, v) of the same number of components with the largest inner products.

    Rows that share the query's id are its own and left out; ties go to the smaller
    id; fewer rows than k: all.  Repeated rows are candidates each; a repeated query
    is one, and two vectors under one id are two queries, ranked apart.  Scores beyond
    a long are cut to its ends.  Empty tables: no rows.
    """

    def many(df: DataFrame, size: int) -> int:
        return max(1, -(-int(df.agg(F.sum(F.size("v") + 1)).first()[0] or 0) * 8 // size))

    # rows in the order of lengths; equal rows differ in where they stand, so that they make no large part
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    told = rows.select(F.size("v").alias("d"), (-squares).alias("order"), "id", "v").withColumn("stands", F.monotonically_increasing_id())
    order = ["d", "order", "id", "stands"]
    n = many(rows, shard_bytes)
    told = told.repartitionByRange(n, *order).coalesce(n).sortWithinPartitions(*order)  # as many as asked for, also where a session deals out more
    shards = _written(told.select("id", "v"), "topk-shards", shard_bytes)
    asked = queries.select("id", "v").dropDuplicates()
    n = many(queries, block_bytes)
    asked = asked.repartition(n, "id", "v").coalesce(n).sortWithinPartitions(F.size("v"), "id")
    blocks = _written(asked, "topk-blocks", block_bytes, turned=False).select("d", F.col("part").alias("block"), F.col("ids").alias("qids"), F.col("vectors").alias("queries"))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                n = len(row.qids) // 8
                least = np.full(n, -np.inf)
                who, near, scores = _meet(row, least, k)
                q = np.frombuffer(row.queries, np.int64).reshape(n, row.d).astype(np.float64)
                length = np.sqrt((q**2).sum(axis=1))
                # the length of a vector that could still reach a query's score
                need = np.where(least > 0, least / np.maximum(length, 1e-300), 0).min() * (1 - 2 * SLACK)
                yield pd.DataFrame({"d": [row.d], "block": [row.block], "qids": [row.qids], "queries": [row.queries], "least": [least.tobytes()], "need": [need], "who": [who.tobytes()], "near": [near.tobytes()], "scores": [scores.tobytes()]})

    # one shard for each number of components, of bounded size
    longest = shards.withColumn("n", F.row_number().over(W.partitionBy("d").orderBy(F.desc("longest"), "part"))).where("n = 1").drop("n", "longest")
    seeds = longest.select("d", F.col("part").alias("seed"))
    met = blocks.join(longest.drop("part"), "d").repartition(max(1, blocks.count()), "d", "block")
    seeded = materialize(met.mapInPandas(first, "d int, block long, qids binary, queries binary, least binary, need double, who binary, near binary, scores binary"), "topk-seeded")

    lists = shards.groupBy("d").agg(F.collect_list(F.struct("longest", "part")).alias("all")).join(seeds, "d")
    pairs = seeded.select("d", "block", "need").join(lists, "d")
    pairs = pairs.select("d", "block", F.explode(F.expr("filter(all, s -> s.longest >= need and s.part != seed)")).alias("s")).select("d", "block", "s.part")
    pairs = materialize(pairs, "topk-pairs")
    posed = pairs.join(shards.drop("longest"), ["d", "part"]).join(seeded.select("d", "block", "qids", "queries", "least"), ["d", "block"])

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                who, near, scores = _meet(row, np.frombuffer(row.least).copy(), k)
                yield pd.DataFrame({"query_id": np.frombuffer(row.qids, np.int64)[who], "block": row.block, "place": who, "vec_id": near, "score": scores})

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                who = np.frombuffer(row.who, np.int64)
                yield pd.DataFrame({"query_id": np.frombuffer(row.qids, np.int64)[who], "block": row.block, "place": who, "vec_id": np.frombuffer(row.near, np.int64), "score": np.frombuffer(row.scores, np.int64)})

    found = posed.repartition(max(1, pairs.count()), "d", "block", "part").mapInPandas(further, FOUND)
    found = found.unionByName(seeded.select("qids", "block", "who", "near", "scores").mapInPandas(unpacked, FOUND))
    rank = F.row_number().over(W.partitionBy("query_id", "block", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: vec_id divisible by 20, against every row of embeddings.  See `usable` and `search` for nulls, ties and empty tables."""
    rows = usable(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where(F.col("id") % 20 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 20 = 0
),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 20
"""
