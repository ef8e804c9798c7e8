"""Pairs of hubs that link targets in common, counted where they are made: lists of numbers are shuffled, no pair is.

Hubs are numbered without gaps, in the order of their names.  Each target's hubs are written as one sorted list.  The numbers
are cut into blocks of about PAIRS_A_TASK pairs, by the pairs that each number's stretch begins; a block is sent, of each
list that enters it, what stands from there on, so that all pairs (a, b) of a block's numbers a come together and are
counted there.  What a task holds is a list, the pairs of one block that differ, and PAIRS_AT_ONCE that aren't yet counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block of hubs begins about so many pairs; so many are made, or numbers of lists dealt, at a time; a batch has so many rows.
PAIRS_A_TASK, PAIRS_AT_ONCE, ROWS = 4_000_000, 4_000_000, 200_000
#: The stretches of numbers that blocks are made of, and hubs at most that are sent whole to where pairs are.
STRETCHES, BROADCAST = 16_384, 2_000_000

_LISTS = pa.schema([("ids", pa.list_(pa.int32()))])
_DEALT = pa.schema([("block", pa.int32()), ("lens", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))])
_COUNTED = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("shared", pa.int64())])
_BEST = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("shared", pa.int64()), ("smaller", pa.int64()), ("ratio", pa.float64()), ("total", pa.int64())])
Batches = Iterator[pa.RecordBatch]


def numbered(placed: DataFrame) -> tuple[DataFrame, int]:
    """name and number (0, 1, ...) of written names with a number (id) that rises with them and has its partition above 33 bits; how many."""
    counts = placed.groupBy(F.shiftright("id", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row for each partition
    before, n = [], 0
    for r in counts:
        before += [F.lit(r.p), F.lit(n)]
        n += r.n
    first = F.element_at(F.create_map(*before), F.shiftright("id", 33)) if before else F.lit(0)
    return placed.select("name", (first + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("number")), n


def sent(hubs: DataFrame, n: int) -> DataFrame:
    """Rows of n hubs, by broadcast unless they are very many."""
    return F.broadcast(hubs) if n <= BROADCAST else hubs


def lists(edges: DataFrame) -> DataFrame:
    """ids: the different numbers of each target_cid of (target_cid, number), sorted."""
    ordered = edges.select("target_cid", "number").repartition("target_cid").sortWithinPartitions(F.xxhash64("target_cid"), "target_cid", "number")  # names often begin alike
    return ordered.mapInArrow(_grouped, "ids array<int>")


def _grouped(batches: Batches) -> Batches:
    name, held = None, np.empty(0, np.int32)
    for batch in batches:
        n, names = batch.num_rows, batch["target_cid"]
        if not n:
            continue
        ids = np.concatenate([held, batch["number"].to_numpy()])
        begins = np.zeros(len(ids), bool)
        begins[0] = True
        begins[len(held)] |= names[0].as_py() != name
        begins[len(held) + 1 :] = pc.not_equal(names.slice(1), names.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        kept = begins | (np.diff(ids, prepend=ids[0]) != 0)
        ids, starts = ids[kept], np.flatnonzero(begins[kept])
        name, held = names[n - 1].as_py(), ids[starts[-1] :]
        yield _listed(ids, starts)  # what is held isn't closed yet
    if len(held):
        yield _listed(held, np.array([0, len(held)]))


def _listed(ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], schema=_LISTS)


def counted(held: DataFrame, n: int) -> DataFrame:
    """a, b, shared: numbers a < b, of n, that stand together in `shared` of the written lists."""
    spark = held.sparkSession
    wide = max(1, -(-n // STRETCHES))
    each = held.select(F.size("ids").alias("_n"), F.posexplode("ids").alias("_at", "id"))
    work = each.groupBy(F.floor(F.col("id") / wide).cast("int").alias("s")).agg(F.sum(F.col("_n") - F.col("_at") - 1).alias("pairs")).orderBy("s").collect()  # a row for each stretch
    pairs = np.array([r.pairs for r in work], dtype=np.int64)
    blocks = max(spark.sparkContext.defaultParallelism, -(-int(pairs.sum()) // PAIRS_A_TASK))
    share = np.cumsum(pairs) - pairs
    share = share * blocks // max(1, int(pairs.sum()))
    bounds = np.array([r.s * wide for r in work], dtype=np.int64)[np.flatnonzero(np.diff(share, prepend=-1))] if work else np.zeros(1, np.int64)
    bounds = np.append(bounds, max(n, 1))
    dealt = held.mapInArrow(partial(_dealt, bounds=bounds), "block int, lens array<int>, ids array<int>")
    return dealt.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(partial(_pairs, bounds=bounds, n=n), "a int, b int, shared long")


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes come to PAIRS_AT_ONCE at most, one at least."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS_AT_ONCE, "right")))
        yield first, last
        first = last


def _dealt(batches: Batches, bounds: np.ndarray) -> Batches:
    for batch in batches:
        values, sizes = batch["ids"].flatten().to_numpy(), np.diff(batch["ids"].offsets.to_numpy())
        if not len(values):
            continue
        block, of = np.searchsorted(bounds, values, "right") - 1, np.repeat(np.arange(len(sizes)), sizes)
        starts = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        lens = np.cumsum(sizes)[of[starts]] - starts
        starts, lens = starts[lens > 1], lens[lens > 1]  # the last of a list begins no pair
        for first, last in _cuts(lens):
            s, k = starts[first:last], lens[first:last]
            order = np.argsort(block[s], kind="stable")
            s, k = s[order], k[order]
            rows = np.append(np.flatnonzero(np.diff(block[s], prepend=-1)), len(s))
            of_lens = pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(k, pa.int32()))
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(k))[rows], pa.int32()), pa.array(values[_ranges(s, k)], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(block[s[rows[:-1]]], pa.int32()), of_lens, ids], schema=_DEALT)


def _pairs(batches: Batches, bounds: np.ndarray, n: int) -> Batches:
    block, keys, times, waiting = None, np.empty(0, np.int64), np.empty(0, np.int64), []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        fresh = np.sort(np.concatenate([*waiting, np.empty(0, np.int64)]))
        at = np.flatnonzero(np.diff(fresh, prepend=-1))
        fresh, counts = fresh[at], np.diff(at, append=len(fresh))
        if not len(keys):
            return fresh, counts
        both, counts = np.concatenate([keys, fresh]), np.concatenate([times, counts])
        order = np.argsort(both, kind="stable")
        both, counts = both[order], counts[order]
        at = np.flatnonzero(np.diff(both, prepend=-1))
        return both[at], np.add.reduceat(counts, at) if len(at) else counts

    def closed() -> Batches:
        found, counts = summed()
        for i in range(0, len(found), ROWS):
            k = found[i : i + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(bounds[block] + (k >> 32), pa.int32()), pa.array(k & 0xFFFFFFFF, pa.int32()), pa.array(counts[i : i + ROWS], pa.int64())], schema=_COUNTED)

    for batch in batches:
        for r in range(batch.num_rows):
            if (now := batch["block"][r].as_py()) != block:
                if block is not None:
                    yield from closed()
                block, keys, times, waiting = now, np.empty(0, np.int64), np.empty(0, np.int64), []
            ids, lens = batch["ids"][r].values.to_numpy(), batch["lens"][r].values.to_numpy()
            later = np.repeat(np.cumsum(lens), lens) - np.arange(len(ids)) - 1
            own = np.flatnonzero((ids < bounds[block + 1]) & (later > 0))
            for first, last in _cuts(later[own]):
                at = own[first:last]
                k = later[at]
                waiting.append(np.repeat((ids[at] - bounds[block]) << 32, k) | ids[_ranges(at + 1, k)])
                if sum(map(len, waiting)) >= PAIRS_AT_ONCE:
                    keys, times = summed()
                    waiting = []
    if block is not None:
        yield from closed()


def best(pairs: DataFrame, limit: int) -> DataFrame:
    """Of each task's rows (a, b, shared, smaller, ratio) the first `limit` by ratio and shared, most first, then a and b; and a row with how many there were (total)."""
    return pairs.select("a", "b", "shared", "smaller", "ratio").mapInArrow(partial(_best, limit=limit), "a int, b int, shared long, smaller long, ratio double, total long")


def _best(batches: Batches, limit: int) -> Batches:
    total, held = 0, None
    for batch in batches:
        total += batch.num_rows
        if held is not None and len(held) == limit:  # what comes after the last of them is told by ratio alone
            batch = batch.filter(pc.greater_equal(batch["ratio"], held["ratio"][limit - 1]))
        if batch.num_rows:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = rows.sort_by([("ratio", "descending"), ("shared", "descending"), ("a", "ascending"), ("b", "ascending")]).slice(0, limit).combine_chunks()
    rows = held.to_pylist() if held is not None else []
    yield pa.RecordBatch.from_pylist([r | {"total": None} for r in rows] + [{"total": total}], schema=_BEST)
