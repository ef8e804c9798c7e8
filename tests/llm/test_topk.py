"""Exact top-k against all products in Python's integers."""

import math

import numpy as np
import pytest

from marginalia.llm import topk
from tests.oracle import compare, connect

SCHEMA = "vec_id long, embedding array<double>, d int, part string, rank int"


def brute(rows: list[tuple], asked, k: int) -> list[tuple]:
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for i, q in {(i, tuple(q)) for i, q in fine if asked(i)}:
        scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in fine if j != i and len(v) == len(q)))[:k]
        found += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(found)


def cases() -> dict[str, list[tuple]]:
    r = np.random.default_rng(5)
    near = r.normal(size=(12, 16))
    return {
        "empty": [],
        "alone": [(0, [1.0, 2.0])],
        "lengths": [(i, (r.normal(size=16) * r.exponential()).tolist()) for i in range(400)],
        "clusters": [(i, (near[i % 12] + 0.1 * r.normal(size=16)).tolist()) for i in range(400)],
        "ties": [(i, [0.02 * (i % 2), 1.0, 0.0]) for i in range(150)] + [(i, [0.0, 0.0, 0.0]) for i in range(150, 220)],
        "awkward": [(None, [1.0]), (0, None), (20, [1.0, None]), (40, [math.inf, 1.0]), (60, [math.nan]), (80, []), (81, []), (100, [0.5]), (101, [0.25]), (100, [-0.5]), (102, [0.25]), (102, [0.25])],
        "large": [(i, [1e6 * (i - 3), 3.0, float(i)]) for i in range(30)] + [(40, [2.0**19, 1.0, 0.0]), (41, [1.0, 2.0**20, 0.0])],
        "hot": [(20, [1.0, 0.0])] * 60 + [(i, [1.0, i / 50]) for i in range(100)],
        "negative": [(i, [-1.0 - i / 64, -2.0] if i % 20 else [1.0, 1.0]) for i in range(120)],
    }


@pytest.mark.parametrize("kind", list(cases()))
@pytest.mark.parametrize("size", [1_500, 4_000_000])
def test_against_all_products(spark, kind, size):
    rows = cases()[kind]
    table = spark.createDataFrame([(i, v, 1, "p", 2) for i, v in rows], SCHEMA)
    usable = topk.usable(table)
    found = topk.search(usable, usable.where("id % 20 = 0"), 7, size, size)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, lambda i: i % 20 == 0, 7)


def test_bounds_prune():
    """On clustered vectors few products are completed, and none that matters is left out."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 32))
    v = np.floor(64 * (centres[r.integers(40, size=8000)] + 0.05 * r.normal(size=(8000, 32)))).astype(np.int64)
    x = v.astype(float)
    v = v[np.argsort(-(x**2).sum(axis=1), kind="stable")]
    x = v.astype(float)
    shard = topk.Shard(np.arange(8000), v, np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1]))
    least = np.full(50, -np.inf)
    who, near, scores, out = shard.best(np.full(50, -1), v[::160], least, 20)
    want = np.sort(v[::160] @ v.T, axis=1)[:, :-21:-1]
    assert (scores.reshape(50, 20) == want).all() and out < 0.4 * 50 * 8000  # 0.32; without bounds 1


def test_query(spark, sf_dir):
    assert compare(spark, "op13", topk.op13, topk.SQL, connect(sf_dir), sf_dir) == ""


def test_beyond_a_long(spark):
    rows = spark.createDataFrame([(0, [1e200, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    usable = topk.usable(rows)
    got = topk.search(usable, usable.where("id = 0"), 2).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, topk.END), (0, 2, 2, -topk.END)]
