"""Approximate nearest neighbours: a hash-prefix forest.

Each tree gives every vector a long string of bits (signs of random
projections) and keeps the strings sorted.  A query descends in every tree to
the vectors with the longest common prefix, then ascends in all trees at once, a
bit at a time; what shares its prefix in any tree is a candidate, and only
candidates are ranked, by their exact inner product.  Inner products become
angles by one more component that brings every vector to the length of the
longest of its shard.

The ascent of a query has no fixed number of candidates.  A vector at an angle t
shares x bits with the query in one of T trees with probability
1 - (1 - (1 - t / pi)^x)^T.  The ascent ends at the depth x at which this is at
least `recall` for the angle of the k-th best candidate so far: whatever is left
out and would be among the k best would have been met with that probability.
Clustered vectors end deep with few candidates; where all are about equally far
it goes on, to the root if need be, at which every row is a candidate.

All rows are indexed, in shards of bounded size, each with a forest of its own;
queries come in blocks of bounded size, each to every shard.  Shards and blocks
are groups of one key that Spark deals out; nothing passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import table

TREES, BITS = 128, 24
RECALL = 0.9
SHARD_BYTES = 16_000_000
BLOCK_BYTES = 4_000_000


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 3):
        """vectors: rows in the order that breaks ties."""
        self.v, self.trees, self.bits = vectors, trees, bits
        n, d = vectors.shape
        squares = (vectors**2).sum(axis=1)
        self.longest = float(np.sqrt(squares.max()))
        self.planes = np.random.default_rng(seed).normal(size=(trees, d + 1, bits)).astype(np.float32)
        whole = np.concatenate([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], axis=1)
        whole = (whole / self.longest).astype(np.float32)
        self.order, self.sorted = np.empty((trees, n), np.int32), np.empty((trees, n), np.int32)
        for t in range(trees):
            h = self.strings(whole, t)
            o = np.argsort(h, kind="stable")
            self.order[t], self.sorted[t] = o, h[o]

    def strings(self, x: np.ndarray, tree: int) -> np.ndarray:
        signs = (x @ self.planes[tree]) > 0
        return signs @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int32))

    def deep_enough(self, cosine: float, recall: float) -> float:
        """The greatest depth at which a vector with this cosine has been met with probability `recall`."""
        share = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
        if share >= 1:
            return self.bits
        if share <= 0:
            return 0
        return float(np.log(1 - (1 - recall) ** (1 / self.trees)) / np.log(share))

    def nearest(self, q: np.ndarray, k: int, recall: float, own: list[np.ndarray]) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """((rows, inner products) of each query by falling product, then row; candidates of all).  own: rows left out."""
        n, m = len(self.v), len(q)
        lengths = np.sqrt((q**2).sum(axis=1))
        whole = np.concatenate([q / lengths[:, None], np.zeros((m, 1))], axis=1).astype(np.float32)
        strings = np.stack([self.strings(whole, t) for t in range(self.trees)])
        low, high = np.empty((self.bits + 1, self.trees, m), np.int32), np.empty((self.bits + 1, self.trees, m), np.int32)
        for depth in range(self.bits + 1):
            shift = self.bits - depth
            for t in range(self.trees):
                first = strings[t] >> shift << shift
                low[depth, t], high[depth, t] = np.searchsorted(self.sorted[t], first), np.searchsorted(self.sorted[t], first + (1 << shift))
        found, scored = [], 0
        for i in range(m):
            met = np.zeros(n, bool)
            met[own[i]] = True
            rows, scores = np.zeros(0, np.int64), np.zeros(0)
            a, b = high[self.bits, :, i], high[self.bits, :, i]  # empty: the descent's ends are what the first step adds
            for depth in range(self.bits, -1, -1):
                left, right = low[depth, :, i], high[depth, :, i]
                if depth == self.bits:
                    pieces = [self.order[t, left[t] : right[t]] for t in np.flatnonzero(left < right).tolist()]
                else:  # what the ascent adds on both sides
                    pieces = [self.order[t, left[t] : a[t]] for t in np.flatnonzero(left < a).tolist()]
                    pieces += [self.order[t, b[t] : right[t]] for t in np.flatnonzero(b < right).tolist()]
                a, b = left, right
                if pieces:
                    here = np.concatenate(pieces)
                    here = np.unique(here[~met[here]])
                    met[here] = True
                    scored += len(here)
                    # the same sum for equal vectors, wherever they stand
                    rows, scores = np.concatenate([rows, here]), np.concatenate([scores, (self.v[here] * q[i]).sum(axis=1)])
                    if len(rows) > k:
                        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                        keep = scores >= edge
                        rows, scores = rows[keep], scores[keep]
                if len(rows) >= k and depth <= self.deep_enough(scores.min() / (lengths[i] * self.longest), recall):
                    break
            best = np.lexsort((rows, -scores))[:k]
            found.append((rows[best], scores[best]))
        return found, scored


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): rows with a key whose vector has only finite components, not all zero.

    Null, empty and zero vectors, and those that hold a null or a component that
    isn't finite, take no part.  Repeated rows stay.  Other columns aren't read.
    """
    v = F.col(column).cast("array<double>")
    fine = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)


def search(rows: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL, trees: int = TREES, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (id, v) its nearest in rows (id, v) of the same number of components, its own id left out.

    Ties go to the smaller id.  Repeated rows are candidates each; a repeated
    query is one.  Fewer than `k` rows: all.  Empty tables: no rows.
    """
    sizes = {r.d: r.n for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row for each number of components
    asked = {r.d: r.n for r in queries.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    shards = {d: max(1, -(-n * d * 8 // shard_bytes)) for d, n in sizes.items()}
    blocks = {d: max(1, -(-n * d * 8 // block_bytes)) for d, n in asked.items()}
    both = [d for d in shards if d in blocks]
    if not both:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def many(of: dict[int, int]) -> F.Column:
        return F.create_map(*[F.lit(x) for d in both for x in (d, of[d])])[F.size("v")]

    def dealt(df: DataFrame, name: str, own: dict[int, int], other: str, others: dict[int, int]) -> DataFrame:
        """A part for each row, and a copy of the row for each part of the other side."""
        df = df.where(F.size("v").isin(both)).withColumn("d", F.size("v")).withColumn(name, F.pmod(F.xxhash64("id", "v"), many(own)))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), many(others).cast("long") - 1)))

    indexed = dealt(rows, "shard", shards, "block", blocks)
    posed = dealt(queries.dropDuplicates(["id", "v"]), "block", blocks, "shard", shards)

    def answer(index: pd.DataFrame, posed: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(index) and len(posed):
            index = index.sort_values("id", kind="stable")
            own, q = index["id"].to_numpy(), np.stack(posed["v"].to_numpy()).astype(np.float64)
            forest = Forest(np.stack(index["v"].to_numpy()).astype(np.float64), trees)
            ids = posed["id"].to_numpy()
            first, last = np.searchsorted(own, ids), np.searchsorted(own, ids, side="right")
            for i in range(0, len(q), 256):
                found, _ = forest.nearest(q[i : i + 256], k, recall, [np.arange(a, b) for a, b in zip(first[i : i + 256], last[i : i + 256], strict=True)])
                parts.append(pd.DataFrame({"query_id": np.repeat(ids[i : i + 256], [len(r) for r, _ in found]), "vec_id": np.concatenate([own[r] for r, _ in found]), "score": np.concatenate([s for _, s in found])}))
        return pd.concat(parts)

    key = ["d", "shard", "block"]
    every = indexed.groupBy(*key).cogroup(posed.groupBy(*key)).applyInPandas(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: vec_id divisible by 20, against every row of embeddings.  See `usable` and `search` for nulls, ties and empty tables."""
    rows = usable(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where(F.col("id") % 20 == 0))
