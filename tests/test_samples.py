"""The least values of groups, also where one group holds most rows, and targets written by hand."""

from pyspark.sql import functions as F

from marginalia.operators import graph, samples


def test_least(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.col("id").cast("string")).alias("k"), (F.col("id") % 5000).alias("x"))
    got = {r.k: (r.first, r.total) for r in samples.least(rows, ["k"], "x", 3).collect()}
    assert got["hot"] == ([0, 1, 2], 4000) and got[None] == ([9, 19, 29], 500) and got["8"] == ([8], 1)
    assert len(got) == 2002
    assert samples.least(rows.withColumn("x", F.lit(None).cast("long")), ["k"], "x", 3).count() == 0
    plan = samples.least(rows, ["k"], "x", 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # tasks keep three of a group before the shuffle


def resolved(spark, cids, targets):
    asked = spark.createDataFrame([(t,) for t in targets], "target string")
    known = spark.createDataFrame([(c,) for c in cids], "cid string")
    return {r.target: (r.cid, r.error, r.candidates, r.total) for r in graph.resolve_targets(asked, known).collect()}


def test_targets(spark):
    many = [f"archive/{i:02}/todo" for i in range(25)] + [f"a{i:02}/wiki/todo" for i in range(25)]
    cids = [*many, "wiki/todo", "wiki/Pods", "projects/a/x", "customers/b/x", "archive/c/y", "archive/d/y", "wiki/up", "projects/UP", "wiki/odd#name"]
    got = resolved(spark, cids, ["todo", "wiki/todo", "WIKI/PODS.md", "[[Pods|x]]", "./wiki/up.MD", "x", "a/x", "y", "none", "", " ", "/wiki/up", "a/../b", "wiki\\todo", "wiki/odd#name", "PROJECTS/up", "x#part", None])
    assert got["todo"] == got["wiki/todo"] == got["wiki\\todo"] == ("wiki/todo", None, None, 1)
    assert got["WIKI/PODS.md"] == got["[[Pods|x]]"] == ("wiki/Pods", None, None, 1)
    assert got["./wiki/up.MD"][0] == "wiki/up" and got["PROJECTS/up"][0] == "projects/UP"
    assert got["x"] == got["x#part"] == (None, "ambiguous", ["customers/b/x", "projects/a/x"], 2) and got["a/x"][0] == "projects/a/x"
    assert got["y"] == (None, "ambiguous", ["archive/c/y", "archive/d/y"], 2)
    assert got["none"] == (None, "not_found", None, 0) and got["wiki/odd#name"][0] == "wiki/odd#name"
    assert {got[t][1] for t in ("", " ", "/wiki/up", "a/../b", None)} == {"invalid"}


def test_one_active_name_among_many_archived(spark):
    got = resolved(spark, [f"archive/{i:02}/todo" for i in range(25)] + ["projects/p/todo"], ["todo", "archive/03/todo", "03/todo"])
    assert got["todo"] == ("projects/p/todo", None, None, 1) and got["03/todo"][0] == "archive/03/todo"
    got = resolved(spark, [f"archive/{i:02}/todo" for i in range(25)], ["todo"])["todo"]
    assert got[1] == "ambiguous" and got[3] == 25 and len(got[2]) == graph.NEIGHBOURS
