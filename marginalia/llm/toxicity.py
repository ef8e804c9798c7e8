"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding maps homoglyphs, accented letters and digit or sign substitutions to one
character each, so that places in the folded text are places in the text.  An
entry counts where it stands as a word of the text and not inside an exception
phrase.  The weights of what matched, as they are and relative to the length,
go into a logistic score.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import bounded_sample_ids, slices, table
from marginalia.llm.language import fold_of

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "χ": "x", "ı": "i"}
#: Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l", "+": "t"}
#: Phrases in which an entry isn't meant as an insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "stupid mistake of mine", "disgusting weather")
#: What isn't seen, and marks over letters, which a letter written in parts has apart.
INVISIBLE = dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)))
SAMPLE_DOCS = 8000
LEXICON_SIZE = 2000
#: An entry must have been seen in so many toxic places with different neighbours, an exception in so many others.
SUPPORT = 5


def _table() -> dict[int, str]:
    fold: dict[int, str] = {}
    # Latin, Greek and Cyrillic; letters in circles, of mathematics and of full width; and whatever is listed above
    blocks = [range(0x20, 0x250), range(0x1E00, 0x1F00), range(0x370, 0x530), range(0x2100, 0x2150), range(0x24B6, 0x24EA), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800)]
    for code in [*(code for block in blocks for code in block), *map(ord, (*HOMOGLYPHS, *SUBSTITUTES))]:
        c = chr(code).lower()
        c = unicodedata.normalize("NFKD", c)[0].lower() if len(c) == 1 else c[0]
        c = HOMOGLYPHS.get(c, SUBSTITUTES.get(c, c))
        fold[code] = "i" if c in "lj" else c  # l, i, j and 1 are written for one another
    return fold


FOLD = _table()
WORD = re.compile(r"[^\W_]+(?:[@$!|€£+][^\W_]+)*")


def visible(text: str) -> str:
    return text if text.isascii() else text.translate(INVISIBLE)


def fold(text: str) -> str:
    """Same length as `text`."""
    return text.translate(FOLD)


@dataclass
class Lexicon:
    weights: dict[str, float]  # by folded entry
    exceptions: tuple[str, ...] = ()  # folded
    coef: tuple[float, float, float] = (0.0, 0.0, 0.0)  # bias, of log1p(weight), of log1p(weight in 100 words)
    _machine: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def machine(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for word, weight in self.weights.items():
                self._machine.add_word(word, (len(word), weight))
            for phrase in self.exceptions:
                self._machine.add_word(phrase, (len(phrase), None))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of entries that stand as words, outside exception phrases; places in visible(text)."""
        machine = self.machine()
        if not text or not len(machine):
            return []
        spared, found = [], []
        for last, (size, weight) in machine.iter(fold(text)):
            start, end = last + 1 - size, last + 1
            if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
                continue
            (spared if weight is None else found).append((start, end, weight))
        # both come by their ends: the earliest start of all phrases that end there or later says whether one holds an entry
        first, kept, k = len(text), [], len(spared)
        for hit in reversed(found):
            while k and spared[k - 1][1] >= hit[1]:
                k -= 1
                first = min(first, spared[k][0])
            if first > hit[0]:
                kept.append(hit)
        return kept[::-1]

    def features(self, text: str | None) -> tuple[float, float]:
        text = visible(text or "")
        total = sum(w for _, _, w in self.hits(text))
        words = text.count(" ") + text.count("\n") + 1
        return float(np.log1p(total)), float(np.log1p(100 * total / words))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        return float(1 / (1 + np.exp(-(self.coef[0] + self.coef[1] * a + self.coef[2] * b))))


def fit(samples: list[tuple[str | None, int]], size: int = LEXICON_SIZE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Weights are smoothed log odds of a word among toxic against other documents; kept where clearly apart from chance.

    Word pairs that hold an entry, and are found in other documents alone or at
    a rate clearly above that in toxic ones, are added to the exception phrases.
    A pair counts once for each two words before and two after it, so near
    copies count once.
    Without samples of both kinds there is an empty lexicon, and every score is
    the base rate.
    """
    toxic, other = {}, {}
    around: dict[str, set[tuple[str, str]]] = {}
    n_t = n_o = 0
    for text, label in dict.fromkeys(samples):  # copies count once
        words = WORD.findall(visible(text or ""))
        words = [fold(w) for w in words]
        count = toxic if label else other
        n_t, n_o = n_t + bool(label), n_o + (not label)
        for w in set(words):
            count[w] = count.get(w, 0) + 1
        if label:
            for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                if len(seen := around.setdefault(w, set())) < SUPPORT:
                    seen.add((before, after))
    base = (n_t + 0.5) / (n_t + n_o + 1)
    lex = Lexicon({}, (), (float(np.log(base / (1 - base))), 0.0, 0.0))
    if not n_t or not n_o:
        return lex
    ranked = []
    for w, a in toxic.items():
        b = other.get(w, 0)
        odds = np.log((a + 0.5) / (n_t - a + 0.5)) - np.log((b + 0.5) / (n_o - b + 0.5))
        error = (1 / (a + 0.5) + 1 / (b + 0.5)) ** 0.5
        # between different words each time: else near copies of one text would vouch for all its words
        if len(w) > 2 and len(around[w]) >= SUPPORT and odds > 2 and odds / error > 3 and a / (a + b) > 0.7:
            ranked.append((odds / error, w, float(odds)))
    ranked.sort(reverse=True)
    lex.weights = {w: odds for _, w, odds in ranked[:size]}
    folded = {fold(e.lower()) for e in exceptions}
    pairs: tuple[dict[tuple[str, str], set[tuple[str, ...]]], ...] = ({}, {})  # of other, of toxic texts: what stands about each
    for text, label in dict.fromkeys(samples):  # pairs of the texts that hold an entry alone: a second, short pass
        if lex.hits(visible(text or "")):
            words = ["", "", *(fold(w) for w in WORD.findall(visible(text))), "", ""]
            for i, (x, y) in enumerate(zip(words[2:-2], words[3:-2], strict=False), 2):
                if x in lex.weights or y in lex.weights:
                    pairs[bool(label)].setdefault((x, y), set()).add((*words[i - 2 : i], *words[i + 2 : i + 4]))
    for (x, y), about in pairs[0].items():
        a, b = len(pairs[1].get((x, y), ())), len(about)
        odds = np.log((a + 0.5) / (n_t + 1)) - np.log((b + 0.5) / (n_o + 1))
        error = (1 / (a + 0.5) + 1 / (b + 0.5)) ** 0.5
        if b >= SUPPORT and (not a or (odds < -2 and odds / error < -3)):
            folded.add(f"{x} {y}")
    lex.exceptions = tuple(sorted(folded))
    lex._machine = None
    x = np.array([(1.0, *lex.features(t)) for t, _ in samples])
    y = np.array([float(bool(v)) for _, v in samples])
    w = np.array(lex.coef)
    for _ in range(30):  # Newton with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w = w - np.linalg.solve(hess, grad)
    lex.coef = tuple(float(v) for v in w)
    return lex


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Lexicon:
    """Learns from at most `sample_docs` labelled documents outside the held-out fold, chosen by hash of doc_id.

    A document labelled more than once counts as toxic if any label says so; null labels are left out.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of("doc_id", 5) != 0))
    ids = bounded_sample_ids(marks, "doc_id", sample_docs)
    known = marks.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").collect()
    return fit([(r.text, r.toxic) for r in sorted(found, key=lambda r: (r.doc_id, r.text or ""))])


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score for every row.

    Null and empty texts get the score of no hit; a null doc_id stays null, and
    repeated rows each give a row.  An empty table gives no rows.  Only doc_id and
    text are read, so other columns may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for batch in slices(batches, 1):
            texts = [visible(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lex.score(t) for t in texts], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by what the labels teach.  See `learn` and `score` for nulls, repeated rows and empty tables."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
