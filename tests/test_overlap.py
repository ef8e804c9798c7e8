"""Pairs of hubs against brute force, with blocks, lists and batches of any size; no pair is shuffled."""

import random
from itertools import combinations

import pyarrow as pa
import pytest

from marginalia.operators import graph, overlap

LINKS = "source_cid string, target_cid string, occurrences int"


def some(spark, seed):
    r = random.Random(seed)
    hubs = [f"h{i}" for i in range(40)]
    rows = [(r.choice([*hubs, "other", "nobody"]), r.choice(["t0", *(f"t{i}" for i in range(30)), "h3", "h4"]), 1) for _ in range(700)]
    rows += [("h1", None, 1), (None, "t1", 1)] + [(h, "everywhere", 1) for h in hubs] + rows[:50]
    of = {}
    for s, t, _ in rows:
        if s in hubs and t and s != t:
            of.setdefault(s, set()).add(t)
    want = {(a, b, len(of[a] & of[b]), min(len(of[a]), len(of[b]))) for a, b in combinations(sorted(of), 2) if of[a] & of[b]}
    listed = [(h, "wiki", "moc", None) for h in [*hubs, "unlinked", "h5"]] + [("other", "wiki", "note", None)]
    return spark.createDataFrame(listed, "cid string, layer string, type string, parse_error string"), spark.createDataFrame(rows, LINKS), want


@pytest.mark.parametrize(("task", "once", "stretches", "sent"), [(4_000_000, 4_000_000, 16_384, 2_000_000), (2000, 7, 16_384, 0), (3000, 100, 3, 5)])
def test_overlap(spark, monkeypatch, task, once, stretches, sent):
    for name, value in (("PAIRS_A_TASK", task), ("PAIRS_AT_ONCE", once), ("STRETCHES", stretches), ("BROADCAST", sent), ("ROWS", 5)):
        monkeypatch.setattr(overlap, name, value)
    notes, links, want = some(spark, task)
    got = [tuple(r) for r in graph.hub_overlap(graph.hubs(notes), links).select("a", "b", "shared", "smaller").collect()]
    assert len(got) == len(want) and set(got) == want
    rows = sorted(((a, b, n, m, n / m) for a, b, n, m in want), key=lambda x: (-x[4], -x[2], x[0], x[1]))
    for limit, least in ((20, 0.0), (3, 0.5)):
        kept = [x for x in rows if x[4] >= least]
        assert [tuple(r) for r in graph.hub_overview(notes, links, limit, least).collect()] == [(*x, len(kept)) for x in kept[:limit]]


def test_no_pairs(spark):
    notes, links, _ = some(spark, 1)
    for n, e in ((notes.limit(0), links), (notes, links.limit(0)), (notes, links.where("target_cid = 'none'"))):
        assert graph.hub_overlap(graph.hubs(n), e).count() == 0 and graph.hub_overview(n, e).collect() == []


def test_no_pair_is_shuffled(spark):
    """Pairs, all different where hubs link at random, were shuffled to be counted, and to be named and sized."""
    notes, links, _ = some(spark, 2)
    plan = graph.hub_overlap(graph.hubs(notes), links)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]
    assert len(dealt) == 1 and "hashpartitioning(block" in dealt[0]


def test_lists_go_on_in_the_next_batch():
    rows = [("x", 1), ("x", 1), ("x", 3), ("y", 3), ("z", 0), ("z", 0), ("z", 2)]
    batch = pa.RecordBatch.from_pydict({"target_cid": [t for t, _ in rows], "number": pa.array([n for _, n in rows], pa.int32())})
    for size in (1, 2, 3, 7):
        got = [x for b in overlap._grouped(batch.slice(i, size) for i in range(0, 7, size)) for x in b["ids"].to_pylist()]
        assert got == [[1, 3], [3], [0, 2]]
