"""Collocations against plain counting, bitmaps against sets of places, and the query against its SQL."""

import re
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import phrases
from tests.oracle import compare, connect

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, w1 string"


def brute(rows, least, longest, top, share):
    pieces: dict[str, list[list[str]]] = {}
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        pieces.setdefault("und" if lang is None else lang, []).extend(re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low))
    found = []
    for lang, own in pieces.items():
        f = Counter(tuple(p[i : i + m]) for p in own for m in range(1, longest + 1) for i in range(len(p) - m + 1))
        n = sum(c for x, c in f.items() if len(x) == 1)
        candidates = {x: c for x, c in f.items() if len(x) > 1 and c >= least}
        kept = []
        for x, a in candidates.items():
            if any(len(y) > len(x) and 100 * b >= share * a and any(y[i : i + len(x)] == x for i in range(len(y))) for y, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[x[:k]] * f[x[k:]]), k) for k in range(1, len(x)))
            kept.append((-score, -a, " ".join(x).encode(), f[x[:k]], f[x[k:]]))
        found += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(found)


def corpus(kind: str) -> list[tuple]:
    r = np.random.default_rng(3)
    words = lambda n, of="ab cd Éé x\x01 AB".split(" "): " ".join(r.choice(of, n))
    return {
        "empty": [],
        "none": [(None, None), ("", "en"), (" \t.,;\n", "de")],
        "mixed": [("".join(words(int(r.integers(1, 6))) + str(r.choice([". ", "!", "\n", "\x0b", "\t ", "  "])) for _ in range(30)), str(r.choice(["en", "de"])) if r.random() < 0.8 else None) for _ in range(25)] + [(None, "en")],
        # one very long piece, and one run of one word: overlaps count
        "long": [(words(3000, [f"w{i}" for i in range(12)]), "en"), ("la " * 500, "fr"), ("la la. la", "fr")],
        "copies": [("Once upon a time, there was", "en")] * 90 + [("upon a midnight", "en")] * 30 + [("a time there", "en")] * 12,
        "und": [("one two", "und")] * 6 + [("One\ttwo", None)] * 6,
    }[kind]


@pytest.mark.parametrize("kind", ["empty", "none", "mixed", "long", "copies", "und"])
@pytest.mark.parametrize("size,bits", [(1 << 20, 1 << 16), (50, 64)])
def test_against_counting(spark, kind, size, bits):
    rows = corpus(kind)
    docs = spark.createDataFrame([(1, t, lang, "p", 2, "w") for t, lang in rows], SCHEMA).repartition(3)
    found = phrases.collocations(docs, size=size, filter_bits=bits)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 10, 3, 2000, 50)


def test_longer_phrases_and_limits(spark):
    rows = corpus("mixed") + corpus("copies")
    docs = spark.createDataFrame([(1, t, lang, "p", 2, "w") for t, lang in rows], SCHEMA)
    found = phrases.collocations(docs, least=4, longest=5, top=17, share=80, size=200, filter_bits=1 << 14)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 4, 5, 17, 80)


def test_bitmaps():
    """Shifted and ANDed bitmaps hold just the places where a phrase ends, past the ends of blocks too."""
    ids = np.random.default_rng(2).integers(-1, 4, 1000).astype(np.int32)
    b = phrases.Bitmaps(ids)
    phrase, word, block, bits = b.extended(b.word, b.block, b.bits)
    got = {}
    for p, w, at, x in zip(phrase, word, block, bits, strict=True):
        got.setdefault((int(p), int(w)), set()).update(int(at) * 64 + i for i in range(64) if int(x) >> i & 1)
    want = {}
    for i in range(999):
        if ids[i] >= 0 and ids[i + 1] >= 0:
            want.setdefault((int(ids[i]), int(ids[i + 1])), set()).add(i + 1)
    assert got == want
    counted = {tuple(int(w[i]) for w in words): int(n[i]) for words, n in b.counted(3, lambda words, m: np.ones(len(words[0]), bool)) for i in range(len(n))}
    assert counted == Counter(tuple(ids[i : i + 3].tolist()) for i in range(998) if (ids[i : i + 3] >= 0).all())


def test_scores_past_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(10**14, 10**14, 10**14), (123_456_789_012_345, 987_654_321_098_765, 123_456_789_012_345), (10, 10, 10**14), (3, 7, 3)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", phrases._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in got)


def test_query(spark, sf_dir):
    assert compare(spark, "op12", phrases.op12, phrases.SQL, connect(sf_dir), sf_dir) == ""
