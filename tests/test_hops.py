"""Links are grouped for a few notes' neighbours alone, and not made distinct before notes are."""

from pyspark.sql import functions as F

from marginalia.operators import graph


def test_two_hop_groups_what_is_near(spark, tmp_path):
    spark.range(20_000).select((F.col("id") % 5000).alias("s"), (F.col("id") % 4999).alias("t")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    links = rows.groupBy("s", "t").agg(F.count("*").alias("occurrences")).select(F.concat(F.lit("n/"), "s").alias("source_cid"), F.concat(F.lit("n/"), "t").alias("target_cid"), "occurrences")
    found = graph.two_hop(links, "n/7")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    semi = next(i for i, x in enumerate(lines) if "Join LeftSemi" in x)
    assert not any("Aggregate" in x for x in lines[semi:])  # it stood above the grouping of all links
    edges = {(f"n/{i % 5000}", f"n/{i % 4999}") for i in range(20_000)}
    near = {t for s, t in edges if s == "n/7"}
    assert {r.cid for r in found.collect()} == {t for s, t in edges if s in near} - near - {"n/7"}


def test_reachable_takes_links_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(graph, "distinct_edges", None)
    links = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("x", "y", 1), ("b", "b", 1), ("c", None, 1)], "source_cid string, target_cid string, occurrences int")
    assert sorted(r.cid for r in graph.reachable(spark.createDataFrame([("a",)], "cid string"), links).collect()) == ["a", "b", "c"]
