"""Pairs of targets, also of sources with more targets than a block holds."""

from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from marginalia.operators import graph


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "PAIRED", block)
    links = {"hub": [f"t{i}" for i in range(40)], "a": ["t1", "t2"], "b": ["t2", "t1", "t39"], "c": ["t5"]}
    rows = [(s, t, 1) for s, ts in links.items() for t in ts] + [("a", None, 1), ("a", "t1", 2)]
    frame = spark.createDataFrame(rows, "source_cid string, target_cid string, occurrences int")
    want = Counter(p for ts in links.values() for p in combinations(sorted(set(ts)), 2))
    assert {(r.a, r.b): r.n for r in graph.co_citation(frame).collect()} == want
    assert {(r.a, r.b): r.n for r in graph.co_citation(frame, least=2).collect()} == {p: n for p, n in want.items() if n > 1}
    assert {r.b: r.n for r in graph.co_citation(frame, "t39").collect()} == {b if a == "t39" else a: n for (a, b), n in want.items() if "t39" in (a, b)}


def test_two_in_common(spark, monkeypatch):
    """A target in many sources' links costs no pair of them all where two in common are asked for."""
    links = [(f"o{i}", "everywhere", 1) for i in range(300)] + [(f"o{i}", f"p{i % 60}", 1) for i in range(300)] + [(f"o{i}", f"q{i % 7}", 1) for i in range(300)]
    frame = spark.createDataFrame(links, "source_cid string, target_cid string, occurrences int")
    made = []
    pairs = graph._pairs
    monkeypatch.setattr(graph, "_pairs", lambda rows, keys: made.append(df := pairs(rows, keys)) or df)
    of = {}
    for s, t, _ in links:
        of.setdefault(s, set()).add(t)
    for least in (2, 3):
        want = {(a, b): len(of[a] & of[b]) for a, b in combinations(sorted(of), 2) if len(of[a] & of[b]) >= least}
        made.clear()
        assert {(r.a, r.b): r.n for r in graph.coupling(frame, least=least).collect()} == want
        assert sum(df.count() for df in made) < 300 * 299 / 2  # the pairs of all that link to `everywhere`


def test_pairs_are_of_numbers(spark):
    """Names aren't shuffled with the pairs, which are most of the work; they were their keys."""
    frame = spark.createDataFrame([("s", f"t{i}", 1) for i in range(30)], "source_cid string, target_cid string, occurrences int")
    rows = graph._written(graph.distinct_edges(frame).select(F.lit(1).alias("k"), F.xxhash64("target_cid").alias("id")))
    assert dict(graph._pairs(rows, ["k"]).select("a", "b").dtypes) == {"a": "bigint", "b": "bigint"}
    assert graph.co_citation(frame).where("a < b").count() == 435
