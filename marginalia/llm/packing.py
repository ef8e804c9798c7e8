"""Best-fit packing by bin completion over the histogram of piece lengths.

A packing depends on lengths alone, and lengths are at most `capacity`.  So the
executors only tokenise and count pieces by length; the plan is made on the
driver from at most `capacity` counters, whatever the size of the corpus, and
each piece then finds its place from its rank among the pieces of its length.

The plan: around the largest remaining length, enumerate undominated fillings of
the rest of the sequence, best fit first; use one as often as the counts allow;
branch over the alternatives; prune when the waste so far exceeds what a better
solution than the incumbent (best-fit decreasing at first) may waste.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, slices, table, tokenizer_of, vocab_json

END_ID = 1
#: Nodes of the search for fewer sequences.
NODES = 5_000
#: Frames of the search that keep their tables (two MB at most); those further up make them anew.
TABLES = 16
Bin = tuple[tuple[int, int], ...]  # (length, times), longest first


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Bin, int]]:
    """(filling, sequences) with each length, longest first, put where it leaves least room."""
    left = dict(sorted(counts.items(), reverse=True))
    open_: dict[Bin, int] = {}
    room: dict[int, list[Bin]] = {}  # by room left
    for length, n in left.items():
        while n:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                per = capacity // length
                full, rest = divmod(n, per)
                for times, bins in ((per, full), (rest, 1)):
                    if times and bins:
                        b: Bin = ((length, times),)
                        open_[b] = open_.get(b, 0) + bins
                        room.setdefault(capacity - length * times, []).append(b)
                n = 0
                continue
            b = room[fit][-1]
            per = fit // length
            use = min(open_[b], max(1, n // per))
            times = per if n >= per else n
            open_[b] -= use
            if not open_[b]:
                del open_[b]
                room[fit].pop()
                if not room[fit]:
                    del room[fit]
            new = (*b, (length, times))
            if new not in open_:
                room.setdefault(fit - length * times, []).append(new)
            open_[new] = open_.get(new, 0) + use
            n -= use * times
    return list(open_.items())


def fillings(left: dict[int, int], space: int) -> Iterator[tuple[int, Bin]]:
    """(room left, filling) of all undominated fillings of `space`, the fullest first; found one at a time.

    Depth first over lengths in falling order, so an item is never preceded by a
    smaller one (no permutations).  A filling is dominated if a remaining item
    fits in what it leaves, so items up to that room are all put in.  An exact
    single item dominates every other filling.  An exact pair comes first.
    """
    if space in left:
        yield 0, ((space, 1),)
        return
    lengths = sorted((x for x in left if x <= space), reverse=True)
    pair = next((((x, 2),) if 2 * x == space else ((x, 1), (space - x, 1)) for x in lengths if space <= 2 * x and left.get(space - x, 0) > (2 * x == space)), None)
    if pair:
        yield 0, pair
    limit = (1 << (space + 1)) - 1
    cut_at, sums = -1, []

    def go(i: int, room: int, chosen: Bin) -> Iterator[Bin]:
        if not room:
            yield chosen
            return
        for j in range(i, cut_at):
            if not sums[j] >> room & 1:
                return  # what follows holds less
            x = lengths[j]
            for times in range(min(left[x], room // x), 0, -1):
                if sums[j + 1] >> (room - times * x) & 1:
                    yield from go(j + 1, room - times * x, (*chosen, (x, times)))

    for room in range(space + 1):
        bigger = sum(x > room for x in lengths) if cut_at < 0 or (cut_at and lengths[cut_at - 1] <= room) else cut_at
        if bigger != cut_at:
            cut_at = bigger
            sums = [1] * (cut_at + 1)  # bit s of the j-th: lengths[j:cut_at] have items of sum s
            for j in range(cut_at - 1, -1, -1):
                bits, n, some = sums[j + 1], min(left[lengths[j]], space // lengths[j]), 1
                while n:
                    some = min(some, n)
                    bits |= bits << (some * lengths[j]) & limit
                    n -= some
                    some *= 2
                sums[j] = bits
        small = tuple((x, left[x]) for x in lengths[cut_at:])
        rest = space - room - sum(x * n for x, n in small)
        if rest < 0:
            return
        if sums[0] >> rest & 1:
            for chosen in go(0, rest, ()):
                if (*chosen, *small) != pair:
                    yield room, (*chosen, *small)


def bin_completion(counts: dict[int, int], capacity: int, budget: int | None = NODES) -> list[tuple[Bin, int]]:
    """(filling, sequences) using as few sequences as found; optimal unless `budget` ends the search.

    `budget` bounds the nodes of the search, as packing is NP-hard; None is the
    exact mode, which has no bound.  The incumbent is always a whole packing.
    """
    counts = {k: v for k, v in counts.items() if v}
    total = sum(k * v for k, v in counts.items())
    floor = -(-total // capacity)
    best = best_fit_decreasing(counts, capacity)
    most = sum(n for _, n in best)
    if most == floor:
        return best
    nodes = 0

    def children(left: dict[int, int], waste: int, skip: int) -> Iterator[tuple[dict[int, int], int, int]]:
        """(what a sequence holds, sequences, room in each): as often as can be, then once."""
        top = max(left)
        rest = dict(left)
        rest[top] -= 1
        if not rest[top]:
            del rest[top]
        for once in (False, True):
            for room, fill in fillings(rest, capacity - top):
                if waste + room > (most - 1) * capacity - total:
                    break  # those after it leave as much or more
                need = {top: 1}
                for x, t in fill:
                    need[x] = need.get(x, 0) + t
                times = min(left[x] // t for x, t in need.items())
                if once and times == 1:
                    continue
                if skip:
                    skip -= 1
                else:
                    yield need, 1 if once else times, room

    # one table of what is left, changed on the way down and restored on the way up; a frame: sequences, waste, children still to try, tried
    left = dict(counts)
    stack: list[list] = [[0, 0, None, 0]]
    trail: list[tuple[dict[int, int], int]] = []
    while stack and most > floor and (budget is None or nodes <= budget):
        frame = stack[-1]
        used, waste, todo, tried = frame
        nxt = None
        if not left:
            if used < most:
                most, best = used, [(tuple(sorted(need.items(), reverse=True)), times) for need, times in trail]
        elif waste <= (most - 1) * capacity - total:
            # the first descent keeps no search's tables; going back makes them anew
            todo = todo or children(left, waste, tried)
            nxt = next(todo, None)
            frame[2], frame[3] = (todo if tried else None), tried + 1
        if nxt is None:
            stack.pop()
            if trail and stack:
                need, times = trail.pop()
                for x, t in need.items():
                    left[x] = left.get(x, 0) + t * times
            continue
        nodes += 1
        need, times, room = nxt
        for x, t in need.items():
            left[x] -= t * times
            if not left[x]:
                del left[x]
        trail.append((need, times))
        stack.append([used + times, waste + room * times, None, 0])
        if len(stack) > TABLES:
            stack[-TABLES - 1][2] = None
    return best


def cut(docs: DataFrame, capacity: int, vocab: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut only where longer than `capacity`."""
    spec = docs.sparkSession.sparkContext.broadcast(vocab_json(vocab))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer_of(spec.value)
        for batch in slices(batches, 1):
            ids_of = batch.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, ids in zip(ids_of, tokens.encode(batch.column(1).to_pylist()), strict=True):
                raw = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for k, at in enumerate(range(0, len(raw), capacity)):
                    part = raw[at : at + capacity]
                    for column, value in zip(out, (doc, k, at, len(part), zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, capacity: int, shards: int = 64, budget: int | None = NODES) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of at most `capacity`.

    Ranks are taken within (length, shard), so that a length that a third of all
    pieces share is ranked by `shards` tasks; where each shard starts follows
    from the counts (capacity x shards numbers at most, on the driver).
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int")), "pieces")
    counted = pieces.groupBy("length", "_shard").count().toPandas()
    per_length = counted.groupby("length")["count"].sum()
    plan = bin_completion({int(k): int(v) for k, v in per_length.items()}, capacity, budget)
    runs: dict[int, list[tuple[int, int, int]]] = {}  # length: (first sequence, times in each, offset)
    sizes: dict[int, list[int]] = {}
    sequence = 0
    for filling, n in plan:
        at = 0
        for length, times in filling:
            runs.setdefault(length, []).append((sequence, times, at))
            sizes.setdefault(length, []).append(n * times)
            at += length * times
        sequence += n
    first = np.zeros((capacity + 1, shards), np.int64)
    for length, shard, n in counted.itertuples(index=False):
        first[length, shard] = n
    first = np.cumsum(first, axis=1) - first
    shared = spark.sparkContext.broadcast((first, {k: (np.cumsum(sizes[k]) - sizes[k], np.array(v)) for k, v in runs.items()}))
    fields = [f for f in pieces.schema.fields if f.name != "_shard"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, runs = shared.value
        for batch in batches:
            length, shard, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_shard", "_rank"))
            k = first[length, shard] + rank - 1
            seq, off = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            for x in np.unique(length):
                here = np.flatnonzero(length == x)
                begins, what = runs[int(x)]
                r = np.searchsorted(begins, k[here], side="right") - 1
                n, times = k[here] - begins[r], what[r, 1]
                seq[here] = what[r, 0] + n // times
                off[here] = what[r, 2] + n % times * x
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    ranked = pieces.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_shard").orderBy("doc_id", "piece", "ids_crc32")))
    from pyspark.sql import types as T

    return ranked.mapInArrow(run, T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack(docs: DataFrame, capacity: int = 4096, vocab: str | None = None, budget: int | None = NODES) -> DataFrame:
    """Packs every document into sequences of at most `capacity` tokens.

    Null or empty texts have the end id alone.  A null doc_id stays null.
    Repeated rows are packed each.  Other columns than doc_id and text are not read.
    An empty table gives no rows.
    """
    return place(cut(docs, capacity, vocab), capacity, budget=budget)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, in sequences of 4,096.  See `pack` for nulls, repeated rows and empty tables."""
    return pack(table(spark, sf_dir, "documents"))
