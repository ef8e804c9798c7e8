"""Listing and reading of folders, in parts of like size, and a collection that is followed on disk."""

import os
import uuid

from pyspark.sql import functions as F

from marginalia.operators import incremental, search
from marginalia.sources import files, notes, vault
from marginalia.sources.shared import shared_dir
from marginalia.sources.snapshots import Snapshots


def put(top, path, text):
    (top / path).parent.mkdir(parents=True, exist_ok=True)
    (top / path).write_text(text)


def test_discover(spark, tmp_path):
    for path in ("wiki/a.md", "wiki/deep/er/b.md", "wiki/c.txt", "wiki/.h.md", "wiki/_u.md", "wiki/AGENTS.md", "wiki/.git/x.md", "wiki/node_modules/x.md", "projects/p.md", "Templates/t.md", "raw/a.TXT", "raw/x/b.pdf", "raw/.hid/c.txt", "log/l.md", "top.md", "out/side.md"):
        put(tmp_path, path, path)
    os.symlink(tmp_path / "out", tmp_path / "wiki/linked")
    os.symlink(tmp_path / "projects/p.md", tmp_path / "wiki/p.md")
    os.symlink(tmp_path / "wiki/a.md", tmp_path / "wiki/same.md")
    found = files.discover(spark, str(tmp_path), "Templates", [".txt"])
    got = {r.rel_path: (r.kind, r.settings) for r in found.collect()}
    note = ("notes", "note")
    assert got == {"wiki/a.md": note, "wiki/deep/er/b.md": note, "wiki/_u.md": note, "wiki/same.md": note, "projects/p.md": note, "out/side.md": note, "raw/a.TXT": ("raw", "text"), "raw/x/b.pdf": ("raw", "name")}
    assert {r.rel_path: bytes(r.content).decode() for r in files.read(found.where("kind = 'raw'"), str(tmp_path)).collect()} == {"raw/a.TXT": "raw/a.TXT", "raw/x/b.pdf": "raw/x/b.pdf"}
    assert files.discover(spark, str(tmp_path / "none")).count() == 0 and files.read(found.limit(0), str(tmp_path)).count() == 0


def test_parts_of_like_size(spark, tmp_path):
    """One folder with most of the files, and a large file, make many tasks of like size."""
    for i in range(1200):
        put(tmp_path, f"wiki/n{i}.md", "x" * (i % 50))
    put(tmp_path, "projects/big.md", "y" * 3_000_000)
    found = files.discover(spark, str(tmp_path))
    rows = files.read(found, str(tmp_path), part_bytes=1_000_000)
    sizes = [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.sum(F.col("file_size") + files.FILE_BYTES).alias("n")).collect()]
    assert rows.count() == 1201 and len(sizes) >= 15 and sorted(sizes)[-2] < 3 * sum(sizes) / len(sizes)


def test_a_followed_folder(spark, tmp_path):
    """From files on disk to search: another list of suffixes reads those raw files again, and nothing else."""
    put(tmp_path, "wiki/a.md", "---\ntype: note\ntitle: A\ndescription: D\nstatus: active\n---\nalpha [[b]] [x](../projects/b.md)\n")
    put(tmp_path, "projects/b.md", "---\ntype: note\ntitle: B\ndescription: D\nstatus: active\n---\nbeta\n")
    put(tmp_path, "raw/r.log", "gamma")
    store, seen = Snapshots(spark, f"{shared_dir(spark)}/followed-{uuid.uuid4().hex}"), []

    def scan(suffixes):
        listing = files.discover(spark, str(tmp_path), suffixes=suffixes)

        def read(paths):
            seen.append(sorted(r.rel_path for r in paths.collect()))
            rows = files.read(listing.join(paths, "rel_path", "left_semi"), str(tmp_path))
            own = notes.notes(rows.where("NOT rel_path LIKE 'raw/%'").select("rel_path", F.decode("content", "UTF-8").alias("text"), "file_size", "mtime"))
            return own.unionByName(notes.raw(rows.where("rel_path LIKE 'raw/%'"), suffixes).drop("file_hash"), allowMissingColumns=True).drop("file_size", "mtime")

        return incremental.scan(store, listing, read, lambda n: notes.note_links(n.where("layer <> 'raw'")))

    version = scan([".txt"])
    links = {(r.kind, r.target, r.target_cid) for r in incremental.links(store, version).collect()}
    assert links == {("wiki", "b", "projects/b"), ("markdown", "../projects/b.md", "projects/b")}
    find = lambda q, corpus="notes": [r.cid for r in search.match(incremental.index(store, store.latest()), q, corpus).collect()]
    assert find("alpha") == ["wiki/a"] and find("gamma", "raw") == []
    scan([".txt", ".log"])
    assert find("gamma", "raw") == ["raw/r.log"]
    os.unlink(tmp_path / "projects/b.md")
    version = scan([".txt", ".log"])
    assert {r.target_cid for r in incremental.links(store, version).collect()} == {None} and find("beta") == []
    assert seen == [["projects/b.md", "raw/r.log", "wiki/a.md"], ["raw/r.log"], []]
