"""Functions and the query language on small fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions import scalar, text
from marginalia.operators import delta, graph, search, status
from marginalia.plans import query_language as ql


@pytest.mark.parametrize(
    ("query", "parts"),
    [
        ("", []),
        ("b-tree index", ['"b-tree"', "index"]),
        ('foo"bar', ["foo", '"bar"']),
        ("AND a OR OR b NOT", ["a", "OR", "b"]),
        ("a AND NOT b", ["a", "NOT", "b"]),
        ("run* ** -- x", ["run*", "x"]),
        ('"two words"*', ['"two words"*']),
    ],
)
def test_clean(query, parts):
    assert ql.clean(query) == parts


def test_precedence():
    a, b, c = (ql.Leaf((x,)) for x in "abc")
    parse = lambda q: ql.parse(ql.clean(q))
    assert parse("a b OR c") == ql.Node("OR", ql.Node("AND", a, b), c)
    assert parse("a OR b NOT c") == ql.Node("OR", a, ql.Node("NOT", b, c))
    assert parse("a AND b NOT c") == ql.Node("AND", a, ql.Node("NOT", b, c))
    assert parse("foo_bar*") == ql.Leaf(("foo", "bar"), True)
    assert parse("--") is None


def test_rewrites():
    assert ql.split_camel(["CrashLoop", "x"]) == ["crash", "loop", "x"] and ql.split_camel(["a", "OR", "AbCd"]) is None and ql.split_camel(["ab"]) is None
    assert ql.any_of(["the", "Tree", "tree", "leaf"]) == ["Tree", "OR", "leaf"] and ql.any_of(["a"]) is None and ql.any_of(["the", "of"]) is None


def test_camel_subwords(spark):
    rows = spark.createDataFrame([("CrashLoopBackOff",), ("SQLiteWAL",), ("FlashAttention3 FP8TensorCore SGLT2i SoAChunkAllocator",), ("plain UPPER 123",), (None,)], "t string")
    got = [r[0] for r in rows.select(text.camel_subwords(F.col("t"))).collect()]
    assert got[0] == ["crash", "loop", "back", "off", "crashloop", "loopback", "backoff", "crashloopback"]
    assert set(got[1]) >= {"sqlite", "wal"} and got[3] == got[4] == []
    assert set(got[2]) >= {"flash", "attention", "flashattention", "fp", "fp8", "tensor", "core", "tensorcore", "sglt", "sglt2", "soa", "soachunk", "chunk", "allocator"}
    assert text.camel_parts("SoAChunkAllocator") == ["soa", "chunk", "allocator"] and text.camel_parts("plain") == []


def test_scalars(spark):
    rows = [("wiki/a.md", "x  \r\n\r\ny\t\n\n"), ("raw/n.md", "x\n\ny"), ("a\\b\\c.md", "\n\nx\n\ny\n")]
    got = spark.createDataFrame(rows, "p string, b string").select(scalar.cid_of(F.col("p")), scalar.layer_of(F.col("p")), scalar.stem_of(F.col("p")), scalar.body_hash(F.col("b"))).collect()
    assert [tuple(r)[:3] for r in got] == [("wiki/a", "wiki", "a"), ("raw/n.md", "raw", "n"), ("a/b/c", "a", "c")]
    assert len({r[3] for r in got}) == 1


def test_trust(spark):
    e = "array<struct<by: string, of: string>>"
    rows = [([("human:a", "h")], "human-reviewed"), ([("agent:a", "h"), ("human:b", "old")], "machine-confirmed"), ([("human:a", "old")], "stale-verified"), ([("who", "h")], "stale-verified"), ([], "unverified"), (None, "unverified")]
    for v, tier in spark.createDataFrame(rows, f"v {e}, t string").select(scalar.trust_tier(F.col("v"), F.lit("h")), "t").collect():
        assert v == tier


NOTE = "cid string, rel_path string, stem string, layer string, title string, description string, type string, status string, trust_tier string, tags string, body string, parse_error string"


@pytest.fixture(scope="module")
def notes(spark):
    make = lambda cid, body, **k: (cid, f"{cid}.md", cid.split("/")[-1], cid.split("/")[0], k.get("title", cid), None, k.get("type", "concept"), k.get("status"), k.get("tier", "unverified"), k.get("tags", ""), body, k.get("error"))
    return spark.createDataFrame([make("wiki/a", "quartz lamp"), make("archive/a", "quartz lamp"), make("wiki/b", "quartz only", tier="human-reviewed"), make("wiki/c", "lamp stand", tags="x b-tree"), make("wiki/d", "crash loop seen"), make("wiki/e", "quartz lamp", error="bad"), make("raw/f.txt", "quartz " * 200), *[make(f"wiki/z{i}", "filler text") for i in range(20)]], NOTE)


@pytest.fixture(scope="module")
def index(notes, tmp_path_factory):
    return search.build(notes, str(tmp_path_factory.mktemp("index")))


def test_search_tiers(index):
    got = [(r.cid, r.tier) for r in search.search(index, "quartz lamp", 10).collect()]
    assert got[:2] == [("wiki/a", 0), ("archive/a", 0)] and {c for c, t in got[2:]} == {"wiki/b", "wiki/c"} and all(t == 2 for _, t in got[2:])
    assert [r.cid for r in search.search(index, "CrashLoop").collect()] == ["wiki/d"]
    assert search.search(index, "--").count() == 0 and search.search(index, "--", tag="B_Tree").count() == 1
    assert [r.cid for r in search.search(index, "quartz", domain="raw").collect()] == ["raw/f.txt"]
    with pytest.raises(ValueError):
        search.search(index, "x", 0)


def test_archive_halves_a_score(index):
    s = {r.cid: r.score for r in search.top(index, "quartz lamp").collect()}
    assert abs(s["wiki/a"] - 2 * s["archive/a"]) < 1e-9


def test_raw_files_leave_scores_alone(notes, index, tmp_path):
    one = {r.cid: r.score for r in search.top(index, "quartz").collect()}
    assert one == {r.cid: r.score for r in search.top(search.build(notes.where("layer != 'raw'"), str(tmp_path)), "quartz").collect()}


def test_six_nodes(spark):
    links = spark.createDataFrame([(a, b, 1) for a, b in ("AB", "AC", "DB", "DC", "BE", "FA")], "source_cid string, target_cid string, occurrences int")
    assert [tuple(r) for r in graph.co_citation(links).collect()] == [("B", "C", 2)]
    assert [tuple(r) for r in graph.coupling(links, least=2).collect()] == [("A", "D", 2)]
    assert {r.cid for r in graph.two_hop(links, "A").collect()} == {"E"} and {r.cid for r in graph.two_hop(links, "F").collect()} == {"B", "C"}
    loop = links.unionByName(spark.createDataFrame([("E", "A", 1)], links.schema))
    assert {r.cid for r in graph.reachable(spark.createDataFrame([("F",)], "cid string"), loop).collect()} == set("FABCE")


def test_delta_and_apply(spark):
    old = spark.createDataFrame([("a", 1.0, 5), ("b", 1.0, 5), ("c", 1.0, 5)], "rel_path string, mtime double, file_size int")
    new = spark.createDataFrame([("a", 1.00001, 5), ("b", 1.0, 6), ("d", 2.0, 1)], old.schema)
    changes = delta.classify(old, new)
    assert {tuple(r) for r in changes.collect()} == {("a", "same"), ("b", "update"), ("c", "delete"), ("d", "insert")}
    assert {(r.rel_path, r.file_size) for r in delta.apply(old, new, changes).collect()} == {("a", 5), ("b", 6), ("d", 1)}


def test_folded_counts_overwrite(spark):
    rows = spark.createDataFrame([("wiki", None), ("wiki", None), ("wiki", "unverified")], "layer string, trust_tier string")
    assert status.folded(rows, "trust_tier", "unverified") == {"unverified": 1}


def test_words_without_a_cut_are_passed_over(spark):
    """The pattern takes every word that has a cut, and no plain or capitalised word; each of those was split four times."""
    words = "Word SoA FP8 aB1c x9 9x X9y ABc Abc AB abc aBC 12ab A1 é9Bc oneTwoThree4Five HTTPServer Der iPhone9 9aB".split()
    rows = spark.createDataFrame([(w,) for w in words] + [(" ".join(words),)], "t string")
    taken = rows.select(F.regexp_extract_all("t", F.lit(text.MIXED), F.lit(0)).alias("w")).collect()[-1].w
    assert {"aB1c", "SoA", "oneTwoThree4Five", "HTTPServer"} <= set(taken) and not {"Word", "Abc", "AB", "Der", "abc"} & set(taken)
    by_hand = lambda w: len(text.camel_parts(w)) > 1 or (len(re.split(text._HUMP, w)) > 1 and any(c.islower() for c in w))
    assert {w for w in words if w.isascii() and by_hand(w)} <= set(taken)
