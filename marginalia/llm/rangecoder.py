"""Token ids as binary: an adaptive context-mixing range coder.

Ids are cut into blocks of at most BLOCK ids, each coded on its own: models are
reset, and the block carries its length, its alphabet and a checksum of its ids
and its bytes.  Three
predictions of the next id are mixed into one distribution over the alphabet:

- order 0: how often each id has been in the block so far;
- order 1: the id that last followed the one before;
- order 2: the id that last followed the two before (by a hash of them).

An id's share is its part of order 0 plus, where orders 1 or 2 predict it, their
weights.  A weight is the odds with which predictions of that order and that
confidence (how often in a row the context was right) have come true.  Frequencies,
weights and contexts all learn with every id.  One range coder step codes an id
under the mixture.

Blocks are coded in lockstep, a lane for each, so that numpy works on many
blocks at once; a block's bytes don't depend on its neighbours.  To encode, a block's ids are
all known, so where an id starts in order 0 at its place is counted ahead for whole blocks.  To
decode, frequencies are sums in three tables: to count an id changes a row of each, and what lies
below an id is read from three entries.  Shares are whole numbers below 2^24 in single precision, so exact.

A container (one row, or one file) holds documents: MAGIC, documents, blocks, a
checksum of these and of the list that follows, each document's id and length,
then the blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import shared_dir, slices, table, tokenizer_of, vocab_json

MAGIC = b"MTC4"
BLOCK = 4096  # at most 4096: a context's entry holds an id's place in the alphabet in 12 bits
LANES = 2048
AHEAD = 64  # lanes whose contexts are looked up ahead at a time: what fits in a cache
CHUNK = 128  # places of a block that are held against each other to count what lies below an id
CONTEXTS = 12  # bits of an order 2 context
EACH = 4  # an id's part of order 0 for every time that it has been
HEAVIEST = 64.0  # a weight's largest odds: all shares together stay below 2^22
NARROW, WIDE = 2.0**32, 2.0**48  # the range's span stays between; all numbers are whole and below 2^53, so exact
NO_DOC = -(1 << 63)  # a null doc_id
_BEFORE, _LAST = 40503, 30011  # of the context hash


class Frequencies:
    """The slots of order 0 by lane: each id has one, and EACH more for every time that it has been.

    Where an id's slots start is what three tables add up to: what lies below its part of all
    ids, below its row in that part, and below it in that row.  A row is 8 numbers, or 16.
    """

    def __init__(self, lanes: int, largest: int):
        """largest: ids in the largest alphabet of a lane."""
        bits = self.bits = 3 if largest <= 1024 else 4
        width = self.width = 1 << bits
        parts = 1
        while parts << 2 * bits < largest:
            parts *= 2
        held = max(parts, 8)  # those past the last one start after all slots
        number = np.arange(16)
        later = ((number > number[:, None]) * EACH).astype(np.uint16)  # by place: for each one after it, four in a number, as slots never run over
        self.later_parts, self.later = (np.ascontiguousarray(later[:, :n]).view(np.uint64) for n in (held, width))
        self.high = np.tile((number[:held] << 2 * bits).astype(np.uint16), (lanes, 1))  # by lane and part
        self.middle = np.tile((number[:width] << bits).astype(np.uint16), (lanes * parts, 1))
        self.low = np.tile(number[:width].astype(np.uint16), (lanes * parts * width, 1))
        self.own = np.ones(lanes * parts * width * width, np.uint16)
        lane = np.arange(lanes)
        self.by_high, self.by_part, self.by_row, self.by_id, self.by_width = lane * held, lane * parts, lane * parts * width, lane * parts * width * width, lane * width
        moved = np.dtype(np.complex128 if width == 8 else "V32")  # a row is moved as one
        self.rows = [t.view(moved).ravel() for t in (self.middle, self.low)]
        self.fours, self.flat_high, self.flat_middle, self.flat_low = self.high.view(np.uint64), self.high.ravel(), self.middle.ravel(), self.low.ravel()

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each lane's id starts, how many slots it has); ids: (..., lanes)."""
        return self.start(ids), self.own.take(ids + self.by_id[: ids.shape[-1]])

    def start(self, ids: np.ndarray) -> np.ndarray:
        n = ids.shape[-1]
        at = ids + self.by_id[:n]
        start = self.flat_low.take(at)
        at >>= self.bits
        start += self.flat_middle.take(at)
        start += self.flat_high.take((ids >> 2 * self.bits) + self.by_high[:n])
        return start

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the id of each lane that holds slot v, which has 16 bits; v's place among that id's slots)."""
        n = len(v)
        rest = v.astype(np.uint16)
        at = _last_before(self.high[:n], rest)
        rest -= self.flat_high.take(at + self.by_high[:n])
        at += self.by_part[:n]
        for table_ in self.rows:
            rows = table_.take(at).view(np.uint16)
            within = _last_before(rows.reshape(n, self.width), rest)
            rest -= rows.take(within + self.by_width[:n])
            at <<= self.bits
            at += within
        at -= self.by_id[:n]
        return at, rest

    def add(self, ids: np.ndarray) -> np.ndarray:
        """Counts an id of each lane; how many slots it had before."""
        n = len(ids)
        at = self.by_id[:n] + ids
        own = self.own.take(at)
        self.own[at] = own + np.uint16(EACH)
        for table_ in self.rows[::-1]:
            within = at & (self.width - 1)
            at >>= self.bits
            row = table_.take(at)
            row.view(np.uint64).reshape(n, -1)[:] += self.later.take(within, axis=0)
            table_[at] = row
        at -= self.by_part[:n]
        fours = self.fours[:n]
        fours += self.later_parts.take(at, axis=0)
        return own


def _last_before(starts: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The last in each row of ascending starts that isn't past v; the first ones are 0, and at most 64 in a row."""
    eights = (starts <= np.repeat(v, starts.shape[1]).reshape(starts.shape)).view(np.uint64)  # a byte for each that starts at or before it
    count = eights[:, 0].copy()
    for k in range(1, eights.shape[1]):
        count += eights[:, k]
    count *= np.uint64(0x0101010101010101)  # their sum is in the highest byte
    count >>= np.uint64(56)
    found = count.view(np.int64)
    found -= 1
    return found


class Weights:
    """The odds with which each order's predictions come true, by lane and confidence."""

    def __init__(self, lanes: int):
        self.seen = np.full((2 * lanes, 8), 1 + 4j, np.complex64)  # hits, and tries as the other part: three misses at first
        self.seen[:, 0] = complex(0, np.inf)  # a context never seen
        self.seen = self.seen.ravel()
        self.first = np.stack([np.arange(lanes) * 8, (lanes + np.arange(lanes)) * 8])

    def of(self, confidence: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(weights by order and lane, what `learn` goes on from)."""
        at = self.first[:, : confidence.shape[1]] + confidence
        seen = self.seen.take(at)
        w = seen.imag - seen.real
        np.divide(seen.real, w, out=w)
        np.minimum(w, HEAVIEST, out=w)
        w *= total
        np.floor(w, out=w)
        return w, (at, seen)

    def learn(self, source: tuple[np.ndarray, np.ndarray], right: np.ndarray) -> None:
        at, seen = source
        seen += _TRIED.take(right.view(np.uint8))
        self.seen[at] = seen


_TRIED = np.array([1j, 1 + 1j], np.complex64)


def _entries(keys: np.ndarray, syms: np.ndarray) -> np.ndarray:
    """What each context holds at each place before its id is learned: id * 8 + confidence, 0 where never seen.

    An entry's confidence is 1 after a miss or the first id, and grows to 7 with hits in a row.
    """
    order = np.argsort(keys, axis=1, kind="stable")
    order += np.arange(len(keys))[:, None] * keys.shape[1]
    key, sym = keys.ravel().take(order), syms.ravel().take(order)
    seen = np.zeros(key.shape, bool)
    seen[:, 1:] = key[:, 1:] == key[:, :-1]
    right = seen.copy()
    right[:, 1:] &= sym[:, 1:] == sym[:, :-1]
    place = np.arange(key.shape[1], dtype=np.uint16)
    run = place - np.maximum.accumulate(np.where(right, np.uint16(0), place), axis=1)
    run += 1
    np.minimum(run, 7, out=run)
    run += sym << 3
    held = np.zeros(key.shape, np.uint16)
    np.multiply(run[:, :-1], seen[:, 1:], out=held[:, 1:])
    out = np.empty_like(held)
    out.ravel()[order] = held
    return out


def _alphabet(block: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's ids in order, and the place of each; places: a table for ids below its length, of any contents."""
    top = int(block.max()) + 1
    if top > len(places):
        return np.unique(block, return_inverse=True)
    ordered = np.sort(block.astype(np.uint16) if top <= 1 << 16 else block, kind="stable")
    alphabet = ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])].astype(np.int64)
    places[alphabet] = np.arange(len(alphabet))
    return alphabet, places[block]


def _held(syms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What both contexts hold at each place, by lane and place."""
    last = np.zeros(syms.shape, np.uint16)
    last[:, 1:] = syms[:, :-1]
    pair = last * np.uint16(_LAST)  # modulo 2^16, of which the low bits are used
    pair[:, 1:] += last[:, :-1] * np.uint16(_BEFORE)
    pair &= (1 << CONTEXTS) - 1
    return _entries(last, syms), _entries(pair, syms)


def _slots(syms: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """What `Frequencies.of` gives for each id before it is added, by lane and place; sizes: of the lanes' alphabets."""
    lanes, n = syms.shape
    order = np.argsort(syms, axis=1, kind="stable")
    order += np.arange(lanes)[:, None] * n
    key, place = syms.ravel().take(order), np.arange(n, dtype=np.uint16)
    first = np.zeros(key.shape, np.uint16)
    np.multiply(place[1:], key[:, 1:] != key[:, :-1], out=first[:, 1:])
    np.maximum.accumulate(first, axis=1, out=first)
    own = np.empty(key.shape, np.uint16)
    own.ravel()[order] = (place - first) * np.uint16(EACH) + np.uint16(1)
    # ids that lie below, in the same chunk by pairs of places, and in the chunks before it by a table
    chunks = -(-n // CHUNK)
    whole = np.zeros((CHUNK, lanes, chunks), np.uint16)
    padded = np.zeros((lanes, chunks * CHUNK), np.uint16)
    padded[:, :n] = syms
    whole[:] = padded.reshape(lanes, chunks, CHUNK).transpose(2, 0, 1)
    near = np.zeros(whole.shape, np.uint8)
    for apart in range(1, CHUNK):
        near[apart:] += (whole[:-apart] < whole[apart:]).view(np.uint8)
    start = near.transpose(1, 2, 0).reshape(lanes, -1)[:, :n].astype(np.uint16)
    chunk = np.arange(n) // CHUNK
    for lane, size in enumerate(sizes):
        at = chunk * (size + 1) + syms[lane]
        before = np.bincount(at + (size + 2), minlength=(chunks + 1) * (size + 1)).astype(np.uint16).reshape(-1, size + 1)
        np.add.accumulate(before, axis=0, out=before)
        np.add.accumulate(before, axis=1, out=before)
        start[lane] += before.ravel().take(at)
    start *= np.uint16(EACH)
    start += syms
    return start, own


def _encode_lanes(blocks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(alphabet, 16-bit words) of each block."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    n_all, longest = len(order), int(lengths[0])
    alphabets = []
    coded, held = np.empty((longest, n_all), np.uint16), np.empty((longest, 2, n_all), np.uint16)
    slots = np.empty((longest, 2, n_all), np.uint16)
    places = np.zeros(1 << 17, np.int32)
    for a in range(0, n_all, AHEAD):
        some = order[a : a + AHEAD]
        syms = np.zeros((len(some), longest), np.uint16)
        for lane, i in enumerate(some):
            alphabet, inverse = _alphabet(blocks[i], places)
            alphabets.append(alphabet)
            syms[lane, : len(inverse)] = inverse
        coded[:, a : a + AHEAD] = syms.T
        for k, (entries, counted) in enumerate(zip(_held(syms), _slots(syms, [len(x) for x in alphabets[a:]]), strict=True)):
            held[:, k, a : a + AHEAD], slots[:, k, a : a + AHEAD] = entries.T, counted.T
    sizes = np.array([len(x) for x in alphabets], np.float32)
    weights = Weights(n_all)
    low, span = np.zeros(n_all), np.full(n_all, WIDE)
    out = np.zeros((n_all, longest * 3 // 2 + 8), np.int32)  # an id takes 22 bits at most
    flat = out.ravel()
    at = np.arange(n_all) * out.shape[1]
    active = np.searchsorted(-lengths, -np.arange(longest))  # lanes longer than t
    for t, n in enumerate(active.tolist()):
        sym, entry = coded[t, :n], held[t, :, :n]
        total = sizes[:n] + EACH * t
        w, source = weights.of(entry & 7, total)
        c = entry >> 3
        right = c == sym
        below, own = slots[t, :, :n]
        lower, mine = w * (c < sym), w * right
        below = lower[0] + below
        below += lower[1]
        own = mine[0] + own
        own += mine[1]
        total += w[0]
        total += w[1]
        weights.learn(source, right)
        s = span[:n]
        unit = s / total
        np.floor(unit, out=unit)  # exact: a quotient of numbers this small isn't rounded up to a whole one
        low[:n] += below * unit
        np.multiply(unit, own, out=s)
        small = np.flatnonzero(s < NARROW)
        while len(small):
            here, place = low.take(small), at.take(small)
            word = np.floor(here / NARROW)
            flat[place] = word
            at[small] = place + 1
            word *= NARROW
            here -= word
            here *= 65536
            low[small] = here
            left = s.take(small)
            left *= 65536
            s[small] = left
            small = small[left < NARROW]
    ends = at + 3 - np.arange(n_all) * out.shape[1]
    rest = low.astype(np.int64)
    flat[at], flat[at + 1], flat[at + 2] = rest >> 32, rest >> 16 & 0xFFFF, rest & 0xFFFF
    out = out[:, : ends.max()].copy()
    while (carry := out >> 16).any():
        out &= 0xFFFF
        out[:, :-1] += carry[:, 1:]
    result: list = [None] * len(blocks)
    for lane, i in enumerate(order):
        result[i] = (alphabets[lane], out[lane, : ends[lane]].astype("<u2"))
    return result


def _decode_lanes(sizes: list[int], alphabets: list[np.ndarray], words: list[np.ndarray]) -> list[np.ndarray]:
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    lengths = np.array([sizes[i] for i in order])
    n_all, longest = len(order), int(lengths[0])
    stream = np.zeros((n_all, max(len(words[i]) for i in order) + 4), np.uint16)
    for lane, i in enumerate(order):
        stream[lane, : len(words[i])] = words[i]
    at = np.arange(n_all) * stream.shape[1] + 3
    code = stream[:, 0] * NARROW + stream[:, 1] * 65536.0 + stream[:, 2]
    stream = stream.ravel()
    span = np.full(n_all, WIDE)
    known = np.array([len(alphabets[i]) for i in order], np.float32)
    most = int(known.max())
    seen, weights = Frequencies(n_all, most), Weights(n_all)
    lane = np.arange(n_all)
    # one table for both orders' contexts: by order and lane
    after = np.zeros(n_all * (most + (1 << CONTEXTS)), np.uint16)
    tables = np.stack([lane * most, n_all * most + (lane << CONTEXTS)])
    context = np.zeros((2, n_all), np.int64)
    out = np.zeros((longest, n_all), np.uint16)
    active = np.searchsorted(-lengths, -np.arange(longest)).tolist()
    for t, n in enumerate(active):
        at_context = tables[:, :n] + context[:, :n]
        entry = after.take(at_context)
        k, c = entry & 7, (entry >> 3).astype(np.int64)
        total = known[:n] + EACH * t
        w, source = weights.of(k, total)
        start = seen.start(c).astype(np.float32)
        both = w[0] + w[1]
        total += both
        s, x = span[:n], code[:n]
        unit = s / total
        np.floor(unit, out=unit)
        v = x / unit
        np.floor(v, out=v)
        v = v.astype(np.float32)
        # a weight's slots stand before those of its id in order 0; the lower id's are taken out first
        first = np.where(c[0] <= c[1], w[0], w[1])
        for edge, room in ((np.minimum(start[0], start[1]), first), (np.maximum(start[0], start[1]), both - first)):
            past = v - edge
            np.maximum(past, 0, out=past)
            np.minimum(past, room, out=past)
            v -= past
        sym, inside = seen.find(v)
        right = c == sym
        lower, mine = w * (c < sym), w * right
        own = mine[0] + seen.add(sym)
        own += mine[1]
        low = lower[0] + (v - inside)
        low += lower[1]
        weights.learn(source, right)
        x -= low * unit
        np.multiply(unit, own, out=s)
        small = np.flatnonzero(s < NARROW)
        while len(small):
            place, here, left = at.take(small), x.take(small), s.take(small)
            here *= 65536
            here += stream.take(place)
            x[small] = here
            at[small] = place + 1
            left *= 65536
            s[small] = left
            small = small[left < NARROW]
        out[t, :n] = sym
        np.minimum(k, 6, out=k)
        k *= right
        k += (out[t, :n] << 3) + np.uint16(1)
        after[at_context] = k
        hashed = context[0, :n] * _BEFORE + sym * _LAST
        np.bitwise_and(hashed, (1 << CONTEXTS) - 1, out=context[1, :n])
        context[0, :n] = sym
    result: list = [None] * n_all
    for lane_, i in enumerate(order):
        result[i] = alphabets[i][out[: sizes[i], lane_]].astype("<u4")
    return result


def _groups(blocks: list) -> list[list]:
    """What is coded in lockstep: even shares of about LANES."""
    n = max(1, round(len(blocks) / LANES))
    return [blocks[len(blocks) * i // n : len(blocks) * (i + 1) // n] for i in range(n) if blocks]


def _head(n_docs: int, n_blocks: int, table_: bytes) -> bytes:
    counts = struct.pack("<II", n_docs, n_blocks)
    return MAGIC + counts + struct.pack("<I", zlib.crc32(table_, zlib.crc32(counts)))


def encode_container(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """Documents (id, ids) as one container."""
    flat = np.concatenate([np.zeros(0, np.uint32), *(ids for _, ids in docs)]).astype("<u4")
    blocks = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
    listed = np.array([NO_DOC if d is None else d for d, _ in docs], "<i8").tobytes() + np.array([len(ids) for _, ids in docs], "<i8").tobytes()
    out = [_head(len(docs), len(blocks), listed), listed]
    for part in _groups(blocks):
        for block, (alphabet, words) in zip(part, _encode_lanes(part), strict=True):
            # the alphabet as gaps: 7 bits a byte, the high bit says that more follow
            gaps = np.diff(alphabet.astype(np.int64), prepend=-1) - 1
            sevens = np.stack([gaps >> 7 * k for k in range(5)], axis=1)
            used = sevens > 0
            used[:, 0] = True
            more = np.zeros_like(used)
            more[:, :-1] = used[:, 1:]
            packed = ((sevens & 127) | more * 128)[used].astype(np.uint8).tobytes()
            body = struct.pack("<IIII", len(block), len(alphabet), len(packed), len(words)) + packed + words.tobytes()
            out += [struct.pack("<I", zlib.crc32(body, zlib.crc32(block))), body]  # of what is coded and of its code
    return b"".join(out)


def decode_container(raw: bytes) -> list[tuple[int | None, np.ndarray]]:
    """What was encoded; ValueError where a checksum or the format doesn't hold."""
    try:
        with np.errstate(divide="ignore", invalid="ignore"):
            return _decoded(raw)
    except (struct.error, IndexError, FloatingPointError, ZeroDivisionError) as e:
        raise ValueError("not a whole container of token ids") from e


def _decoded(raw: bytes) -> list[tuple[int | None, np.ndarray]]:
    if raw[:4] != MAGIC:
        raise ValueError("not a container of token ids")
    n_docs, n_blocks = struct.unpack_from("<II", raw, 4)
    at = 16
    if len(raw) < at + 16 * n_docs or raw[:at] != _head(n_docs, n_blocks, raw[at : at + 16 * n_docs]):
        raise ValueError("the list of documents fails its checksum")
    ids = np.frombuffer(raw, "<i8", n_docs, at)
    lens = np.frombuffer(raw, "<i8", n_docs, at + 8 * n_docs)
    at += 16 * n_docs
    heads, alphabets, words, sums, bodies = [], [], [], [], []
    for k in range(n_blocks):
        sums.append(struct.unpack_from("<I", raw, at)[0])
        head = struct.unpack_from("<IIII", raw, at + 4)
        bodies.append((at + 4, at + 20 + head[2] + 2 * head[3]))
        at += 20
        gaps = np.frombuffer(raw, np.uint8, head[2], at).astype(np.int64)
        last = np.flatnonzero(gaps < 128)
        first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
        shift = np.arange(head[2]) - np.repeat(first, last - first + 1) if len(last) else np.zeros(head[2], np.int64)
        values = np.add.reduceat((gaps & 127) << (7 * shift), first) if len(first) else first
        at += head[2]
        if not 0 < head[1] == len(values) <= head[0] <= BLOCK:
            raise ValueError(f"block {k} has a broken alphabet")
        alphabets.append(np.cumsum(values + 1) - 1)
        words.append(np.frombuffer(raw, "<u2", head[3], at))
        at += 2 * head[3]
        heads.append(head)
    flat = []
    for part in _groups(list(zip(heads, alphabets, words, strict=True))):
        flat += _decode_lanes([h[0] for h, _, _ in part], [a for _, a, _ in part], [w for _, _, w in part])
    for k, (block, (a, b)) in enumerate(zip(flat, bodies, strict=True)):
        if zlib.crc32(raw[a:b], zlib.crc32(block)) != sums[k]:
            raise ValueError(f"block {k} fails its checksum")
    whole = np.concatenate([np.zeros(0, "<u4"), *flat])
    if len(whole) != lens.sum():
        raise ValueError("documents and blocks differ in length")
    ends = np.cumsum(lens)
    return [(None if d == NO_DOC else int(d), whole[e - n : e]) for d, n, e in zip(ids.tolist(), lens.tolist(), ends.tolist(), strict=True)]


def in_order(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, text in ascending order over partitions and within them.

    Partitions are told apart by doc_id and how a text begins, which keeps the
    order: Spark samples these keys to the driver, and texts may be long.
    """
    begins = F.substring("text", 1, 100)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id", begins).sortWithinPartitions("doc_id", "text")


def write(docs: DataFrame, path: str, vocab: str | None = None, end_id: int = 1) -> None:
    """Writes all documents' ids, each with `end_id`, in ascending doc_id order (nulls first; ties by text).

    A row of the Parquet files at `path` is a container; shard and part give the order.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(vocab_json(vocab))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, shard, part = tokenizer_of(spec.value), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([size], pa.int64()), pa.array([encode_container(held)], pa.binary())], names=["shard", "part", "n_tokens", "payload"])

        for batch in slices(batches, 1):
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist()), strict=True):
                held.append((doc, np.append(ids, np.uint32(end_id))))
                size += len(ids) + 1
                if size >= LANES * BLOCK:
                    yield row()
                    held, size, part = [], 0, part + 1
        if held:
            yield row()

    in_order(docs, shards).mapInArrow(run, "shard int, part int, n_tokens long, payload binary").write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: every block is decoded and checked."""
    files = spark.read.schema("shard int, part int, n_tokens long, payload binary").parquet(path)
    heads = files.select("shard", "part", "n_tokens")
    per_shard = heads.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row for each partition written
    at, offsets = 0, []
    for r in per_shard:
        offsets.append((r.shard, at))
        at += r.n
    first = spark.createDataFrame(offsets, "shard int, first long")
    begins = heads.withColumn("inside", F.sum("n_tokens").over(W.partitionBy("shard").orderBy("part")) - F.col("n_tokens")).join(first, "shard").select("shard", "part", (F.col("first") + F.col("inside")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, part, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                docs = decode_container(payload)
                lens = np.array([len(ids) for _, ids in docs], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(docs), pa.int32()), pa.array([part] * len(docs), pa.int32()), pa.array([d for d, _ in docs], pa.int64()), pa.array(np.cumsum(lens) - lens), pa.array(lens), pa.array([zlib.crc32(np.ascontiguousarray(ids, "<u4")) for _, ids in docs], pa.int64())], names=["shard", "part", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = files.select("shard", "part", "payload").mapInArrow(run, "shard int, part int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(begins, ["shard", "part"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts count as empty (the end id alone); an empty table gives no rows."""
    import uuid

    path = f"{shared_dir(spark)}/marginalia/token-ids-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
