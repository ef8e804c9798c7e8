"""Phrase collocations from compressed position bitmaps.

The corpus is written once as shards of one language and bounded size: word numbers in order of
place, with a break between pieces.  In a shard every word has a bitmap of the places where it
stands, compressed to its non-empty blocks of 64 places.  A phrase's bitmap marks its last words; shifted by
one and ANDed with a word's bitmap it is that of the longer phrase, and the count of its bits
is how often that stands in the shard.  A phrase is ANDed only with words that hold one of its shifted
bits: the lowest bit names the word whose bitmap is next, until none is left.  Phrases grow depth
first, a batch of first words at a time, so memory doesn't grow with the number of phrases.  Counts of all shards are summed by Spark.

No phrase is more frequent than its parts.  So words rarer than `least` are breaks, and a
phrase is only extended, or counted, where its frequent parts of one word less may be among the
frequent phrases: a Bloom filter of fixed size says so.  What it lets through wrongly is counted too and
dropped by its sum, so results are exact whatever its size.

Rules: null texts are empty and null languages are `und`.  A text without words adds nothing, repeated
rows count each, an empty table has no phrases.  Counts below 10 ** 15 are scored exactly.  Only
the two named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import materialize, slices, table

LEAST, LONGEST, TOP, SHARE, SCALE = 10, 3, 2000, 50, 1_000_000
#: A shard ends after so many words; what a task holds for all languages together is bounded by twice that.
SHARD = 1 << 18
#: First words are taken in batches of about so many blocks.
BATCH = 1 << 17
FILTER_BITS = 1 << 26
UNKNOWN = "und"

_BREAK = b"\xff"  # no text in UTF-8 has this byte
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)


def words_of(text: bytes) -> list[bytes]:
    """Words, and a break for each sign between pieces."""
    return text.translate(_FOLD).replace(b"\n", b" \xff ").split()


_WIDTH = {2: np.uint16, 4: np.int32}


class _Buffer:
    """A shard in the making."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.number[_BREAK]
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, text: bytes) -> None:
        words = words_of(text + b"\n")
        ids = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        ids = ids[(ids != 0) | (np.concatenate([[0], ids[:-1]]) != 0)]  # one break in a row
        self.parts.append(ids)
        self.n += len(ids)


SHARDS = "lang string, shard long, width int, ids binary, words array<string>, counts array<long>"


def shards(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SHARD) -> DataFrame:
    """lang, shard, ids (number of the word at each place, 0 for a break; width bytes each), words and counts by number, the break aside."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = count(TaskContext.get().partitionId() << 32)
        held: dict[str, _Buffer] = {}

        def whole(name: str) -> pa.RecordBatch:
            b = held.pop(name)
            ids = np.concatenate(b.parts)
            words = [w.decode() for w in list(b.number)[1:]]
            width = 2 if len(words) < 1 << 16 else 4
            return pa.RecordBatch.from_pydict({"lang": [name], "shard": [next(made)], "width": [width], "ids": [ids.astype(_WIDTH[width]).tobytes()], "words": [words], "counts": [np.bincount(ids, minlength=len(words) + 1)[1:]]}, schema)

        for batch in slices(batches, 1):
            texts: dict[str, list[bytes]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                texts.setdefault(UNKNOWN if name is None else name, []).append(t or b"")
            for name, own in texts.items():
                held.setdefault(name, _Buffer()).add(b"\n".join(own))
                if held[name].n >= size:
                    yield whole(name)
            while sum(b.n for b in held.values()) > 2 * size:
                yield whole(max(held, key=lambda x: held[x].n))
        for name in list(held):
            yield whole(name)

    schema = pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
    return docs.select(F.col(lang).cast("string"), F.col(text).cast("string")).mapInArrow(build, SHARDS)


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """A 64-bit number for each row of word numbers."""
    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        h ^= p.astype(np.uint64)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


class Filter:
    """A Bloom filter of two bits a phrase."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.mask = np.uint64(len(slots) * 64 - 1)

    @staticmethod
    def bits(parts: list[np.ndarray], mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        h = _mixed(parts)
        return h & mask, (h >> np.uint64(32)) & mask

    def has(self, parts: list[np.ndarray]) -> np.ndarray:
        found = np.ones(len(parts[0]), bool)
        for b in self.bits(parts, self.mask):
            found &= (self.slots[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1
        return found

    @classmethod
    def of(cls, phrases: DataFrame, names: list[str], bits: int) -> Filter:
        """Made on the executors; what reaches the driver is the filter, of fixed size."""

        def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(bits // 64, np.uint64)
            for batch in batches:
                for b in cls.bits([batch.column(i).to_numpy() for i in range(len(names))], np.uint64(bits - 1)):
                    np.bitwise_or.at(own, b >> np.uint64(6), np.uint64(1) << (b & np.uint64(63)))
            used = np.flatnonzero(own)
            for i in range(0, len(used), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(used[i : i + 65536]), pa.array(own[used[i : i + 65536]].view(np.int64))], ["slot", "bits"])

        made = phrases.select(*names).mapInArrow(slots, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
        whole = np.zeros(bits // 64, np.uint64)
        whole[made["slot"].to_numpy()] = made["bits"].to_numpy().view(np.uint64)
        return cls(whole)


class Bitmaps:
    """All words' bitmaps of a shard: (word, block of 64 places, bits), by word."""

    def __init__(self, ids: np.ndarray):
        """ids: the word at each place, -1 for none."""
        place = np.flatnonzero(ids >= 0)
        both = np.sort(ids[place].astype(np.int64) << 32 | place)
        word, place = both >> 32, both & 0xFFFFFFFF
        starts = np.flatnonzero(np.diff(both >> 6, prepend=-1))
        self.word, self.block = word[starts], place[starts] >> 6
        self.bits = np.bitwise_or.reduceat(np.uint64(1) << (place & 63).astype(np.uint64), starts) if len(starts) else np.zeros(0, np.uint64)
        # which of them holds a place
        self.holder = np.full((len(ids) // 64 + 2) * 64, -1, np.int32)
        self.holder[place] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(place)))

    def extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, next word, block, bits) of every phrase with every word that follows it."""
        over = np.flatnonzero(bits >> np.uint64(63))
        phrase, block, bits = np.concatenate([phrase, phrase[over]]), np.concatenate([block, block[over] + 1]), np.concatenate([bits << np.uint64(1), np.ones(len(over), np.uint64)])
        found = []
        while True:
            if not (some := bits != 0).all():
                phrase, block, bits = phrase[some], block[some], bits[some]
            if not len(bits):
                return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
            low = bits & (~bits + np.uint64(1))
            holder = self.holder[block * 64 + np.bitwise_count(low - np.uint64(1))]
            held = holder >= 0
            both = bits & self.bits[holder]
            found.append((phrase[held], self.word[holder[held]], block[held], both[held]))
            bits = bits & ~np.where(held, both, low)

    def counted(self, length: int, allowed) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """(words of phrases of `length`, their counts).  allowed(words, m): which phrases of m < length words, and ends of longer ones, may be frequent."""
        last = int(self.word[-1]) + 1 if len(self.word) else 0
        firsts = np.searchsorted(self.word, np.arange(last + 1))
        low = 0
        while low < last:
            high = max(low + 1, int(np.searchsorted(firsts, firsts[low] + BATCH, side="right")) - 1)
            span = slice(firsts[low], firsts[high])
            words, phrase, block, bits = [np.arange(low, high)], self.word[span] - low, self.block[span], self.bits[span]
            for m in range(2, length + 1):
                phrase, word, block, bits = self.extended(phrase, block, bits)
                if not len(phrase):
                    break
                key = phrase * last + word
                order = np.argsort(key, kind="stable")
                key, block, bits = key[order], block[order], bits[order]
                starts = np.flatnonzero(np.diff(key, prepend=-1))
                words = [w[key[starts] // last] for w in words] + [key[starts] % last]
                sizes = np.diff(starts, append=len(key))
                keep = allowed(words, m)
                if m == length:
                    yield [w[keep] for w in words], np.add.reduceat(np.bitwise_count(bits).astype(np.int64), starts)[keep]
                    break
                stay = np.repeat(keep, sizes)
                words, block, bits = [w[keep] for w in words], block[stay], bits[stay]
                phrase = np.repeat(np.arange(len(words[0])), sizes[keep])
            low = high


def _names(n: int, first: int = 1) -> list[str]:
    return [f"w{i}" for i in range(first, first + n)]


def _counts(posed: DataFrame, length: int, filters: dict[int, Filter], least: int) -> DataFrame:
    """w1..: the numbers of all phrases of `length` words that stand at least `least` times, and a, their counts."""
    sent = {m: posed.sparkSession.sparkContext.broadcast(f.slots) for m, f in filters.items()}  # each of fixed size

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {m: Filter(b.value) for m, b in sent.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), _WIDTH[batch.column("width")[i].as_py()])
                numbers, every = batch.column("numbers")[i].values.to_numpy(), batch.column("every")[i].values.to_numpy()
                # words in the shard by their number there, then among the frequent ones
                of = np.full(int(ids.max(initial=0)) + 1, -1, np.int32)
                of[numbers] = np.arange(len(numbers))
                of[0] = -1

                def allowed(words: list[np.ndarray], m: int, every=every) -> np.ndarray:
                    whole = [every[w] for w in words]
                    found = np.ones(len(words[0]), bool)
                    if m in known:
                        found &= known[m].has(whole)
                    elif m - 1 in known:
                        found &= known[m - 1].has(whole[1:])
                    return found

                for words, n in Bitmaps(of[ids]).counted(length, allowed):
                    for j in range(0, len(n), 65536):
                        yield pa.RecordBatch.from_arrays([*(pa.array(every[w[j : j + 65536]]) for w in words), pa.array(n[j : j + 65536])], [*_names(length), "a"])

    schema = ", ".join(f"{c} long" for c in [*_names(length), "a"])
    return posed.mapInArrow(build, schema).groupBy(*_names(length)).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), in decimals: the products have up to 36 digits."""
    whole = [x.cast("decimal(15,0)") for x in (a, left, right)]
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (whole[0] * whole[0]), whole[1] * whole[2])


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, size: int = SHARD, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of 2 to `longest` words of each language.

    a: how often the phrase stands in a piece; l, r: the same of its parts at the cut with the
    lowest score (ties: the earliest); n: all words of the language.  A phrase is left out if a longer one
    with at least `share` % of its count holds it.  Ranks go by score and count, falling, then by phrase.
    """
    whole = materialize(shards(docs, text, lang, size), "phrases-shards")
    vocabulary = whole.select("lang", "shard", F.posexplode(F.arrays_zip("words", "counts"))).select("lang", "shard", (F.col("pos") + 1).alias("number"), "col.words", "col.counts").withColumnRenamed("words", "word")
    sums = materialize(vocabulary.groupBy("lang", "word").agg(F.sum("counts").alias("a")), "phrases-words")
    sizes = sums.groupBy("lang").agg(F.sum("a").alias("n"))
    words = materialize(sums.where(F.col("a") >= least).withColumn("w", F.monotonically_increasing_id()), "phrases-frequent")
    numbers = vocabulary.join(words, ["lang", "word"]).groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("number", "w"))).alias("known"))
    posed = whole.select("shard", "width", "ids").join(numbers.select("shard", F.col("known.number").alias("numbers"), F.col("known.w").alias("every")), "shard")
    posed = materialize(posed, "phrases-posed").select("width", "ids", "numbers", "every")
    found = {1: words.select(F.col("w").alias("w1"), "a")}
    filters: dict[int, Filter] = {}
    for m in range(2, longest + 1):
        found[m] = materialize(_counts(posed, m, filters, least), f"phrases-{m}")
        if m < longest:
            filters[m] = Filter.of(found[m], _names(m), filter_bits)

    scored = []
    for m in range(2, longest + 1):
        rows = found[m].join(words.select(F.col("w").alias("w1"), "lang"), "w1")
        cuts = []
        for k in range(1, m):
            for side, part, first in (("l", k, 1), ("r", m - k, k + 1)):
                own = found[part].toDF(*_names(part, first), f"{side}{k}")
                rows = rows.join(own, _names(part, first))
            cuts.append(F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        longer = [found[j].select(*[F.col(f"w{s + i}").alias(f"w{i}") for i in range(1, m + 1)], "a") for j in range(m + 1, longest + 1) for s in range(j - m + 1)]
        if longer:
            inside = longer[0]
            for x in longer[1:]:
                inside = inside.union(x)
            rows = rows.join(inside.groupBy(*_names(m)).agg(F.max("a").alias("most")), _names(m), "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
        rows = rows.withColumn("cut", F.array_min(F.array(*cuts)))
        scored.append(rows.select("lang", "a", "cut.l", "cut.r", "cut.score", *_names(m), *[F.lit(None).cast("long").alias(c) for c in _names(longest - m, m + 1)]))
    every = scored[0]
    for x in scored[1:]:
        every = every.union(x)
    every = materialize(every, "phrases-scored").withColumn("bin", F.col("score") / 1000)
    every = every.withColumn("bin", F.floor("bin"))
    # the bin of scores in which the last of the top lies: counts of at most 1,001 bins a language
    bins = every.groupBy("lang", "bin").agg(F.count("*").alias("here"))
    above = F.sum("here").over(W.partitionBy("lang").orderBy(F.desc("bin"))) - F.col("here")
    bins = bins.withColumn("above", above).where(F.col("above") < top).select("lang", "bin")
    best = every.join(bins, ["lang", "bin"])
    for i in range(1, longest + 1):
        best = best.join(words.select(F.col("w").alias(f"w{i}"), F.col("word").alias(f"t{i}")), f"w{i}", "left")
    best = best.withColumn("phrase", F.concat_ws(" ", *[f"t{i}" for i in range(1, longest + 1)]))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of two or three words of each language of documents."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
counts AS (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS phrase FROM words, (VALUES (1), (2), (3)) v(m) WHERE len(w) >= m
  ) GROUP BY ALL
),
cuts AS (
  SELECT c.lang, c.m, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.f * c.f // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM counts WHERE m > 1 AND f >= 10) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = c.phrase[:k]
  JOIN counts r ON r.lang = c.lang AND r.phrase = c.phrase[k + 1:]
),
candidates AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_pairs AS (
  SELECT lang, part AS phrase, max(f) AS most FROM (SELECT lang, f, unnest([phrase[:2], phrase[2:]]) AS part FROM counts WHERE m = 3 AND f >= 10) GROUP BY ALL
),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_pairs i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.most IS NULL OR 100 * i.most < 50 * c.a
),
ranked AS (
  SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
