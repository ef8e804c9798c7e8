"""What a link asks for is worked out once for each link."""

from marginalia.operators import resolve

LINKS = [
    ("wiki/deep/a", "markdown", "../b.md#Top", "markdown", "wiki/b"),
    ("wiki/a", "markdown", "../../b.md", None, None),
    ("wiki/a", "markdown", "/b.md", None, None),
    ("wiki/a", "markdown", "./c/../b%20c+d.MD", "markdown", "wiki/b c+d"),
    ("wiki/a", "markdown", "b.txt", None, None),
    ("wiki/a", "markdown", "", None, None),
    ("wiki/a", "wiki", "/x\\y.md", "wiki", "x/y"),
    ("wiki/a", "wiki", "", None, None),
    ("wiki/a", "other", "b", None, None),
    ("wiki/a", "markdown", None, None, None),
]


def test_probes(spark):
    rows = spark.createDataFrame([r[:3] for r in LINKS], "source_cid string, kind string, target string")
    made = resolve.probes(rows).where("by IS NOT NULL OR by IS NULL")
    got = {(r.source_cid, r.kind, r.target): (r.by, r.name) for r in made.collect()}
    assert got == {r[:3]: r[3:] for r in LINKS}
    plan = resolve.probes(rows).where("by IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("aggregate(") <= 2  # steps were folded dozens of times for a link
