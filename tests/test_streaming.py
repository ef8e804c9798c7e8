"""Notes as a stream of files."""

from marginalia.streaming import notes


def test_ingest(spark, tmp_path):
    root, table, state = tmp_path / "c", str(tmp_path / "t"), str(tmp_path / "s")
    (root / "wiki").mkdir(parents=True)
    (root / "raw").mkdir()
    (root / "wiki/a.md").write_text("---\ntitle: A\n---\nOne")
    (root / "raw/x.md").write_text("no note")
    (root / "top.md").write_text("no note")
    notes.ingest(notes.arriving(spark, str(root)), table, state, once=True).awaitTermination(60)
    assert {(r.cid, r.title, r.body) for r in notes.current(spark, table).collect()} == {("wiki/a", "A", "One")}
    (root / "wiki/b.md").write_text("---\ntitle: B\n---\nTwo")
    (root / "wiki/c.md").write_text("broken")
    notes.ingest(notes.arriving(spark, str(root), 1), table, state, once=True).awaitTermination(60)
    got = {r.cid: r for r in notes.current(spark, table).collect()}
    assert set(got) == {"wiki/a", "wiki/b", "wiki/c"} and got["wiki/c"].parse_error == "no header" and got["wiki/b"].title == "B"
