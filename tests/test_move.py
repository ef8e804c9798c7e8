"""Moves, take-overs and stems on written cases."""

import pytest

from marginalia.functions.stemming import porter, stems
from marginalia.operators import move


def frame(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))


def test_plan(spark):
    cids = frame(spark, [("wiki/a",), ("archive/a",), ("wiki/b",)], "cid")
    links = frame(spark, [("wiki/b", "a"), ("wiki/b", "wiki/a"), ("wiki/b", "x/a"), ("wiki/a", "b"), ("wiki/b", None)], "source_cid target_raw")
    moves = frame(spark, [("wiki/a", "projects/x/a")], "cid new_cid")
    got = {(r.source_cid, r.target_raw, r.was, r.will, r.action) for r in move.plan(links, cids, moves).collect()}
    assert got == {("wiki/b", "wiki/a", "wiki/a", None, "rewrite"), ("wiki/b", "x/a", None, "projects/x/a", "newly_resolved")}
    assert move.plan(links, cids, moves.limit(0)).count() == 0
    assert [r.new_cid for r in move.collisions(cids, frame(spark, [("wiki/a", "wiki/b")], "cid new_cid")).collect()] == ["wiki/b"]


def test_takeovers(spark):
    cids = frame(spark, [("projects/a",), ("projects/b",)], "cid")
    links = frame(spark, [("projects/b", "a"), ("projects/a", "b"), ("projects/a", "new")], "source_cid target_raw")
    got = [tuple(r) for r in move.takeovers(links, cids, frame(spark, [("wiki/a",), ("wiki/new",)], "cid")).collect()]
    assert got == [("a", "projects/a", "wiki/a")]


CASES = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit vietnamization vietnam triplicate triplic formative form formalize formal electrical electr hopeful hope goodness good revival reviv allowance allow adjustment adjust adoption adopt probate probat rate rate cease ceas controll control roll roll running run is is x x".split()


@pytest.mark.parametrize("word, stem", list(zip(CASES[::2], CASES[1::2], strict=True)))
def test_porter(word, stem):
    assert porter(word) == stem


def test_stems(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, array('running', 'straße', '')), (2, array()), (3, null) AS t(k, w)")
    got = {r.k: r.s for r in rows.select("k", stems("w").alias("s")).collect()}
    assert got == {1: ["run", "straße", ""], 2: [], 3: None}


def spans_of(spark, rows):
    """(source, kind, target[, start, end, embed, angle])"""
    whole = [(r + (100 * i, 100 * i + 50, False, False)[len(r) - 3 :]) if len(r) < 7 else r for i, r in enumerate(rows)]
    return spark.createDataFrame(whole, "source_cid string, kind string, target string, start int, end int, embed boolean, angle boolean")


def test_blocked_where_another_note_takes_a_name(spark):
    """[[x]] means projects/x; a note that becomes wiki/x would take it over."""
    cids = frame(spark, [("projects/x",), ("wiki/y",), ("wiki/s",)], "cid")
    moves = frame(spark, [("wiki/y", "wiki/x")], "cid new_cid")
    got = [tuple(r) for r in move.plan(frame(spark, [("wiki/s", "x")], "source_cid target_raw"), cids, moves).collect()]
    assert got == [("wiki/s", "x", "projects/x", "projects/x", "wiki/x", "blocked")]
    got = {(r.target, r.action, r.text) for r in move.plan_spans(spans_of(spark, [("wiki/s", "wiki", "x"), ("wiki/s", "wiki", "y")]), cids, moves).collect()}
    assert got == {("x", "blocked", None), ("y", "rewrite", "x")}


def test_spans(spark):
    cids = frame(spark, [("wiki/a",), ("projects/p/b",), ("wiki/c",), ("projects/q/d",), ("wiki/v1.5",)], "cid")
    moves = frame(spark, [("wiki/a", "projects/new/a b"), ("wiki/c", "archive/c"), ("wiki/v1.5", "projects/v1.5"), ("projects/q/d", "projects/q/e#1")], "cid new_cid")
    rows = [
        ("projects/p/b", "wiki", "a"), ("projects/p/b", "wiki", "wiki/c"), ("projects/p/b", "wiki", "c"), ("projects/p/b", "wiki", "new/a b"),
        ("projects/p/b", "markdown", "../../wiki/a.md"), ("projects/p/b", "definition", "../../wiki/c.md", 500, 550, False, True), ("projects/p/b", "markdown", "../new/a%20b.md"), ("projects/p/b", "markdown", "../../raw/a.md"),
        ("projects/p/b", "image", "../../wiki/a.md"), ("wiki/a", "markdown", "c.md"), ("wiki/a", "image", "pics/x.png"), ("wiki/a", "markdown", "../projects/p/b.md#top"), ("wiki/a", "markdown", "/root.md"),
        ("projects/p/b", "wiki", "v1.5", 2000, 2010, True, False), ("projects/p/b", "wiki", "wiki/v1.5"), ("projects/p/b", "wiki", "d"), ("projects/p/b", "wiki", "none"),
    ]
    got = {(r.source_cid, r.kind, r.target): (r.action, r.text) for r in move.plan_spans(spans_of(spark, rows), cids, moves).collect()}
    here = lambda kind, target: got.get(("projects/p/b", kind, target))
    assert here("wiki", "a") == ("rewrite", "projects/new/a b") and here("wiki", "wiki/c") == ("rewrite", "archive/c")
    assert here("wiki", "c") == ("fragile", None) and here("wiki", "new/a b") == ("newly_resolved", None)
    assert here("markdown", "../../wiki/a.md") == ("rewrite", "../new/a%20b.md") and here("definition", "../../wiki/c.md") == ("rewrite", "../../archive/c.md")
    assert here("markdown", "../new/a%20b.md") == ("newly_resolved", None) and here("markdown", "../../raw/a.md") is here("image", "../../wiki/a.md") is None
    assert got["wiki/a", "markdown", "c.md"] == ("rewrite", "../../archive/c.md") and got["wiki/a", "image", "pics/x.png"] == ("rewrite", "../../wiki/pics/x.png")
    assert got["wiki/a", "markdown", "../projects/p/b.md#top"] == ("rewrite", "../p/b.md") and ("wiki/a", "markdown", "/root.md") not in got
    assert here("wiki", "v1.5") in (("fragile", None), ("rewrite", "projects/v1.5")) and here("wiki", "wiki/v1.5") == ("rewrite", "projects/v1.5")
    assert here("wiki", "d") == ("blocked", "projects/q/e#1") and here("wiki", "none") is None


def test_a_rewrite_within_a_rewrite_is_left_out(spark):
    cids = frame(spark, [("wiki/a",), ("wiki/s",)], "cid")
    moves = frame(spark, [("wiki/a", "projects/a")], "cid new_cid")
    rows = [("wiki/s", "markdown", "a.md", 0, 90, False, False), ("wiki/s", "wiki", "wiki/a", 10, 20, False, False), ("wiki/s", "wiki", "wiki/a", 90, 95, False, False)]
    got = sorted((r.start, r.text) for r in move.plan_spans(spans_of(spark, rows), cids, moves).collect())
    assert got == [(0, "../projects/a.md"), (90, "projects/a")]


def test_warnings_and_approvals(spark):
    cids = frame(spark, [("wiki/a",), *[(f"wiki/s{i}",) for i in range(40)]], "cid")
    moves = frame(spark, [("wiki/a", "projects/a")], "cid new_cid")
    planned = move.plan_spans(spans_of(spark, [(f"wiki/s{i}", "wiki", "a" if i else "wiki/a") for i in range(40)]), cids, moves)
    assert [tuple(r) for r in move.fragile_warnings(planned).collect()] == [("projects/a", ["wiki/s1.md: [[a]]", "wiki/s10.md: [[a]]", "wiki/s11.md: [[a]]"], 39)]
    notes = frame(spark, [("wiki/s0", "human-reviewed"), ("wiki/s1", "human-reviewed"), ("wiki/a", "unverified")], "cid trust_tier")
    assert [tuple(r) for r in move.approvals(planned, notes).collect()] == [("wiki/s0", "human-reviewed")]
