"""Language ID: a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows,
each filter keeps its maximum, and a softmax over those maxima gives the
languages.  A text is cut into windows from its first byte to its last; their
mean log probabilities, weighted by length, decide.  As embeddings are looked up
by byte, a filter is a sum of table rows: inference adds rows of byte-pair
tables and needs no multiplication.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import slices, table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
#: At most so many labelled documents of each language, chosen by hash, and so many windows of each are learned from.
SAMPLE_DOCS = 1000
SAMPLE_WINDOWS = 2
BUCKETS = 64
#: Letters, and numbers that aren't decimal digits.
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's categories L."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def windows_of(raw: bytes, width: int = WINDOW) -> np.ndarray:
    """Every byte of a text in rows of `width`; the last row is padded with zeros."""
    n = max(1, -(-len(raw) // width))
    out = np.zeros(n * width, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, width)


@dataclass
class ByteConv:
    """Tables hold whole numbers of 1 / SCALE: sums and maxima of 16-bit rows are quick."""

    langs: list[str]
    first: np.ndarray  # by byte pair: the first two bytes' part of the filters of widths 2, 3 and 4
    third: np.ndarray  # by byte: the third byte's part of width 3
    second: np.ndarray  # by byte pair: the last two bytes' part of width 4
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    plain: dict[str, np.ndarray]  # the trained weights that the tables come from

    SCALE = 512

    def log_probs(self, rows: np.ndarray) -> np.ndarray:
        pairs = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        f = FILTERS
        begin = np.take(self.first, pairs, axis=0, mode="clip")
        pooled = [begin[:, :, :f].max(axis=1)]
        three = np.take(self.third, rows[:, 2:], axis=0, mode="clip")
        three += begin[:, :-1, f : 2 * f]
        pooled.append(three.max(axis=1))
        four = np.take(self.second, pairs[:, 2:], axis=0, mode="clip")
        four += begin[:, :-2, 2 * f :]
        pooled.append(four.max(axis=1))
        h = np.maximum(np.concatenate(pooled, axis=1) / np.float32(self.SCALE) + self.bias, 0)
        z = h @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(samples: list[tuple[bytes, str]], epochs: int = 3, seed: int = 7, rate: float = 4e-3) -> ByteConv | None:
    """Adam on the cross entropy of windows (bytes, language), each of which counts to WINDOW bytes; None without samples."""
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for raw, lang in samples:
        row = windows_of(raw)[0]
        if rng.random() < 0.3:  # short texts too
            row[int(rng.integers(8, WINDOW)) :] = 0
        rows.append(row)
        labels.append(langs.index(lang))
    x, y = np.array(rows), np.array(labels)
    p = {"emb": rng.normal(0, 0.3, (256, EMBED)).astype(np.float32), "out": np.zeros((FILTERS * len(WIDTHS), len(langs)), np.float32), "ob": np.zeros(len(langs), np.float32), "b": np.zeros(FILTERS * len(WIDTHS), np.float32)}
    p["emb"][0] = 0
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
    p["out"] = rng.normal(0, 0.2, p["out"].shape).astype(np.float32)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step, size = 0, 32
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), size):
            take = order[at : at + size]
            xb, yb = x[take], y[take]
            e = p["emb"][xb]
            n = len(xb)
            cols, tops, pooled = {}, {}, []
            for w in WIDTHS:
                col = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, WINDOW - w + 1, w * EMBED)
                z = col @ p[f"w{w}"]
                tops[w] = z.argmax(axis=1)
                cols[w] = col
                pooled.append(np.take_along_axis(z, tops[w][:, None], 1)[:, 0])
            pre = np.concatenate(pooled, axis=1) + p["b"]
            h = np.maximum(pre, 0)
            logits = h @ p["out"] + p["ob"]
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            d = prob.copy()
            d[np.arange(n), yb] -= 1
            d /= n
            g = {"out": h.T @ d, "ob": d.sum(axis=0)}
            dh = (d @ p["out"].T) * (pre > 0)
            g["b"] = dh.sum(axis=0)
            g["emb"] = np.zeros_like(p["emb"])
            for k, w in enumerate(WIDTHS):
                dz = dh[:, k * FILTERS : (k + 1) * FILTERS]
                chosen = cols[w][np.arange(n)[:, None], tops[w]]  # n, filters, w * embed
                g[f"w{w}"] = np.einsum("nfi,nf->if", chosen, dz)
                back = dz[:, :, None] * p[f"w{w}"].T[None]  # n, filters, w * embed
                at_bytes = xb[np.arange(n)[:, None, None], tops[w][:, :, None] + np.arange(w)]
                np.add.at(g["emb"], at_bytes.ravel(), back.reshape(-1, EMBED))
            g["emb"][0] = 0
            step += 1
            for name in p:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                p[name] = p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    def one(w: int, j: int) -> np.ndarray:
        return p["emb"] @ p[f"w{w}"].reshape(w, EMBED, FILTERS)[j]

    def two(w: int, j: int) -> np.ndarray:
        return (one(w, j)[:, None] + one(w, j + 1)[None]).reshape(65536, FILTERS)

    def whole(t: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(t * ByteConv.SCALE), -16000, 16000).astype(np.int16)

    return ByteConv(langs, whole(np.concatenate([two(2, 0), two(3, 0), two(4, 0)], axis=1)), whole(one(3, 2)), whole(two(4, 2)), p["b"], p["out"], p["ob"], p)


def predict(model: ByteConv | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, probability); ('und', 0.0) for null texts and texts without a letter, or without a model."""
    result: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if model is None:
        return result
    at = 0
    while at < len(texts):
        rows, owner, weight, n = [], [], [], 0
        while at < len(texts) and n < 1024:  # half a MB of windows at a time, or one long text
            text = texts[at]
            if text and has_letter(text):
                raw = text.encode("utf-8", "replace")
                cut = windows_of(raw)
                size = np.full(len(cut), WINDOW)
                size[-1] = len(raw) - WINDOW * (len(cut) - 1)
                rows.append(cut)
                weight.append(size)
                owner.append(np.full(len(cut), at))
                n += len(cut)
            at += 1
        if not rows:
            continue
        block, owners, w = np.concatenate(rows), np.concatenate(owner), np.concatenate(weight)
        logp = np.concatenate([model.log_probs(block[i : i + 64]) for i in range(0, len(block), 64)])
        first = np.flatnonzero(np.diff(owners, prepend=-1))
        mean = np.add.reduceat(logp * w[:, None], first) / np.add.reduceat(w, first)[:, None]
        prob = np.exp(mean - mean.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        for k, best, p in zip(owners[first].tolist(), prob.argmax(axis=1).tolist(), prob.max(axis=1).tolist(), strict=True):
            result[k] = (model.langs[best], float(p))
    return result


def fold_of(key: str, folds: int) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ByteConv | None:
    """Trains on at most `sample_docs` documents of each lang with text and lang, outside the held-out fold, chosen by hash of doc_id.

    Of each, SAMPLE_WINDOWS windows from places anywhere in its whole text,
    chosen by hash, come to the driver.  `sample_docs` is a bound for each lang,
    so that a rare one is learned too.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (fold_of("doc_id", 4) != 2))
    # the first of each lang are among the first of its buckets, so no task reads more than BUCKETS * sample_docs rows
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = named.groupBy("lang", "doc_id").agg(F.lit(1)).select("lang", "doc_id").withColumn("_b", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(BUCKETS)))
    known = known.withColumn("_k", F.row_number().over(W.partitionBy("lang", "_b").orderBy(*first))).where(F.col("_k") <= sample_docs)
    ids = known.withColumn("_k", F.row_number().over(W.partitionBy("lang").orderBy(*first))).where(F.col("_k") <= sample_docs).select("lang", "doc_id")
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    places = F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(k)), room) for k in range(SAMPLE_WINDOWS)])
    rows = named.join(F.broadcast(ids), ["lang", "doc_id"]).where(F.col("text").rlike(r"\p{L}"))
    cut = rows.withColumn("_place", F.explode(places)).select("doc_id", "lang", F.col("text").substr((F.col("_place") + 1).cast("int"), F.lit(WINDOW)).alias("part"))
    # of texts that differ under one doc_id, as many windows as of one text
    few = F.row_number().over(W.partitionBy("lang", "doc_id").orderBy(F.xxhash64("part"), "part"))
    found = cut.distinct().withColumn("_k", few).where(F.col("_k") <= SAMPLE_WINDOWS).select("doc_id", "lang", "part").collect()
    return train([(r.part.encode("utf-8", "replace"), r.lang) for r in sorted(found)])


def identify(docs: DataFrame, model: ByteConv | None) -> DataFrame:
    """doc_id, lang_pred, score for every row.

    Null texts, empty texts and texts without a letter: `und`, score 0.  Equal
    probabilities: the first language by name.  Repeated rows each give a row, a
    null doc_id stays null, and an empty table gives no rows.  Only doc_id and
    text are read, so other columns may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = predict(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by what `learn` draws from them.  See `identify` for nulls, repeated rows and empty tables."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


#: Documents below this probability of any learned language are rejected; so are those without a letter.
MIN_SCORE = 0.4


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejects documents of no learned language; the others keep all columns of documents.

    Null and empty texts are rejected; an empty table gives no rows.
    """
    names = docs.columns
    model = learn(docs)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            found = predict(shared.value, batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= MIN_SCORE for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, schema)
