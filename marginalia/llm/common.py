"""Helpers shared by the operators: table access, shared storage, fast exact tokenisation."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain, pairwise, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a single machine's Spark (master local) gets a temporary
    one; on a cluster that would be many folders, so there it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        app = spark.sparkContext.applicationId
        where = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="marginalia-"))
    return where.rstrip("/")


_OWN: dict[str, str] = {}


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that `column`'s texts in each make about `size` bytes at most (a longer text stands alone).

    What an operator holds as Python objects is then bounded by bytes, not rows.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        share = (np.cumsum(lens) - 1) // size
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            yield batch.slice(a, b - a)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marginalia/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample_ids(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most `bound` keys, the first by hash, so that the choice doesn't depend on partitioning."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(bound)


def vocab_json(path: str | None = None) -> str:
    """The vocabulary file's text (a fixed few MB), read on the driver so that executors don't need the file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


#: Characters whose normalisation and classes are the same for Python and the tokenizers library.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*\Z")
_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
#: Pre-tokens of word_bpe_49k.json that aren't letters alone, over the plain characters in lower case; what is left between them and white space are the others.
_APART = f"'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\s{_LETTERS}0-9]+"
#: Characters past ASCII as the model spells their bytes.
_AS_BYTES = {c: "".join(chr(b) if 161 <= b <= 172 or b >= 174 else chr(0x122 + b - 128) if b < 161 else chr(0x143) for b in chr(c).encode()) for c in range(0x80, 0x100)}
_ID = attrgetter("id")
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class WordTokenizer:
    """Exact ids of the tokenizers library, with a bounded memo of words.

    A word is a pre-token, which never holds white space.  BPE never crosses one,
    so each distinct one is encoded once by the library's model, many in a call, and then looked up.  Texts with characters outside `_PLAIN`, or
    that may hold a special token's string, go to the library whole.  Other
    vocabularies than the lower-casing word BPE also go to the library whole.

    The memo holds at most `MEMO` words of at most `LONGEST` characters; when
    it is full, the `KEPT` most used stay.
    """

    MEMO, KEPT, LONGEST = 300_000, 120_000, 200

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Tokenizer.from_str(spec)
        self.model = self.library.model
        parsed = json.loads(spec)
        split = ((parsed.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        kinds = [n.get("type") for n in (parsed.get("normalizer") or {}).get("normalizers", [])]
        self.fast = kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == _SPLIT
        if self.fast:
            self.special = re.compile("|".join(re.escape(t["content"]) for t in parsed["added_tokens"]) or r"(?!)")
            # the same model over pre-tokens that are spelled and split already; where it marks a pre-token's last id, many go in one text
            self.many = Tokenizer(self.model)
            self.many.pre_tokenizer = CharDelimiterSplit(" ")
            self.last = np.zeros(1 + max(parsed["model"]["vocab"].values(), default=0), bool)
            if suffix := parsed["model"].get("end_of_word_suffix"):
                self.last[[i for t, i in parsed["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self._reset()

    def _library(self, texts: list[str]) -> list:
        """The library's encodings of whole texts."""
        return self.library.encode_batch_fast(texts, add_special_tokens=False)

    def library_ids(self, text: str) -> list[int]:
        """What the library itself makes of a text."""
        return self._library([text])[0].ids

    def _reset(self) -> None:
        self.index: dict[str, int] = {"": 0}  # what stands between spaces at a text's ends
        self.flat = np.zeros(1 << 16, np.uint32)
        self.offset = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _make_room(self) -> None:
        """Keeps the most used entries."""
        n = len(self.index)
        kept = np.sort(np.argsort(-self.uses[1:n], kind="stable")[: self.KEPT]) + 1
        words, uses = list(self.index), self.uses[kept] >> 1
        ids, lens = self.ids_of(kept), self.length[kept]
        self._reset()
        self._store([words[i] for i in kept.tolist()], ids, lens)
        self.uses[1 : len(kept) + 1] = uses

    def _store(self, part: list[str], flat: np.ndarray, lens: np.ndarray) -> None:
        n = len(self.index)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(part) > len(self.offset):
            self.offset, self.length, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length, self.uses))
        self.flat[self.used : self.used + len(flat)] = flat
        self.offset[n : n + len(part)] = self.used + np.cumsum(lens) - lens
        self.length[n : n + len(part)] = lens
        self.used += len(flat)
        self.index.update(zip(part, range(n, n + len(part)), strict=True))

    def _encode(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of pre-tokens in lower case, how many each has)."""
        text = " ".join(fresh)
        for c in () if text.isascii() else set(text):
            if not c.isascii():  # no character stands for a byte and is in lower case itself
                text = text.replace(c, _AS_BYTES[ord(c)])
        spelled = text.split(" ")
        found = self.many.encode_batch_fast([" ".join(spelled[i : i + 500]) for i in range(0, len(spelled), 500)], add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32)
        lens = np.diff(np.flatnonzero(self.last[flat]), prepend=-1)
        if len(lens) != len(fresh) or lens.sum() != len(flat):  # a model without such marks, or that leaves characters out
            ids = [[*map(_ID, self.model.tokenize(p))] for p in spelled]
            flat, lens = np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        return flat, lens

    def _learn(self, words: list[str]) -> None:
        """Adds pre-tokens that aren't held, of which many are new."""
        for i in range(0, len(words), 5_000):
            self._store(words[i : i + 5_000], *self._encode(words[i : i + 5_000]))

    def rows(self, words: list[str], times: np.ndarray | None = None) -> np.ndarray:
        """Memo rows of pre-tokens (see `length`), valid until the next call; times: how often each is met."""
        rows = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        if (missing := np.flatnonzero(rows < 0)).size:
            if len(self.index) > self.MEMO:
                self._make_room()
                return self.rows(words, times)
            self._learn(list(dict.fromkeys(words[i] for i in missing.tolist())))
            get = self.index.get
            rows[missing] = np.fromiter((get(words[i]) for i in missing.tolist()), np.int64, missing.size)
        n = len(self.index)
        if len(rows) < n >> 5:  # a few words: the memo isn't gone through for them
            np.add.at(self.uses, rows, 1 if times is None else times)
        else:
            self.uses[:n] += np.bincount(rows, times, minlength=n).astype(np.int64)
        return rows

    def ids_of(self, rows: np.ndarray) -> np.ndarray:
        lens = self.length[rows]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.offset[rows] - (ends - lens), lens) + np.arange(total)]

    def _plain(self, text: str) -> bool:
        return self.fast and _PLAIN.match(text) is not None and not ("<" in text and self.special.search(text))

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(memo rows of the pre-tokens of all plain texts, where each text's begin and end, texts that hold a run without an end)."""
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.string())), _APART, r" \0 "))
        bounds, words = split.offsets.to_numpy(), split.flatten()
        if (long := np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) > self.LONGEST)).size:
            held = np.unique(np.searchsorted(bounds, long, side="right") - 1).tolist()
            rows, bounds, _ = self._words([("" if i in held else t) for i, t in enumerate(texts)])
            return rows, bounds, held
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy()
        rows = self.rows(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.bincount(at, minlength=len(coded.dictionary)))
        return rows[at], bounds, []

    def _some(self, texts: list[str | None]) -> Iterator[list[str]]:
        """The texts in lists of about two million characters (a longer text ends one)."""
        i = 0
        while i < len(texts):
            some: list[str] = []
            chars = 0
            while i < len(texts) and chars < 2_000_000:
                some.append(texts[i] or "")
                chars += len(some[-1])
                i += 1
            yield some

    def counts(self, texts: list[str | None]) -> list[int]:
        """How many ids each text has, without putting them together."""
        out: list[int] = []
        for some in self._some(texts):
            plain = [k for k, t in enumerate(some) if self._plain(t)]
            rows, bounds, long = self._words([some[k] for k in plain])
            found = dict(zip(plain, np.diff(np.concatenate([[0], np.cumsum(self.length[rows])])[bounds]).tolist(), strict=True))
            for n in long:
                del found[plain[n]]
            out += [found[k] if k in found else len(self.library_ids(t)) for k, t in enumerate(some)]
        return out

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text (null: empty), as uint32, a bounded amount of text at a time.

        Arrow splits and numbers the pre-tokens of some texts, so that each distinct one is looked up once.
        """
        for some in self._some(texts):
            plain = [k for k, t in enumerate(some) if self._plain(t)]
            rows, bounds, long = self._words([some[k] for k in plain])
            ids = self.ids_of(rows)
            ends = np.concatenate([[0], np.cumsum(self.length[rows])])[bounds].tolist()
            found = {k: ids[ends[n] : ends[n + 1]] for n, k in enumerate(plain)}
            for n in long:
                del found[plain[n]]
            slow = [k for k in range(len(some)) if k not in found]
            found |= {k: np.asarray(e.ids, np.uint32) for k, e in zip(slow, self._library([some[k] for k in slow]) if slow else (), strict=True)}
            for k in range(len(some)):
                yield found[k]


_HELD: dict[str, WordTokenizer] = {}


def tokenizer_of(spec: str) -> WordTokenizer:
    """One tokenizer per Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if spec not in _HELD:
        _HELD.clear()
        _HELD[spec] = WordTokenizer(spec)
    return _HELD[spec]
