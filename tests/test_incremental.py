"""Versions against concurrent writers and broken manifests; index and links that follow changes against rebuilt ones."""

import json
import os
import random
import threading
import uuid

from pyspark.sql import functions as F

from marginalia.operators import delta, incremental, resolve, search
from marginalia.sources.snapshots import Snapshots, Version, _Store
from marginalia.sources.shared import shared_dir

COLUMNS = "rel_path string, cid string, layer string, title string, description string, body string, tags string, aliases string, subwords string, type string, status string, trust_tier string, parse_error string, wanted string"


def fresh(spark) -> Snapshots:
    return Snapshots(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}")


class Vault:
    """Notes by path in memory, and a log of what was read."""

    def __init__(self, spark):
        self.spark, self.files, self.read_paths, self.clock = spark, {}, [], 0

    def put(self, path: str, body: str, wanted: str = "", broken: bool = False, settings: str = "") -> None:
        self.clock += 1
        self.files[path] = (float(self.clock), body, wanted, broken, settings)

    def listing(self):
        return self.spark.createDataFrame([(p, t, len(b), s) for p, (t, b, _, _, s) in self.files.items()], "rel_path string, mtime double, file_size long, settings string")

    def notes(self, paths):
        some = sorted(r.rel_path for r in paths.collect())
        self.read_paths += some
        rows = [(p, p if p.startswith("raw/") else p[:-3], p.split("/")[0], "A title", None, self.files[p][1], "en", "", "", "note", "active", "unverified", "broken" if self.files[p][3] else None, self.files[p][2]) for p in some]
        return self.spark.createDataFrame(rows, COLUMNS)

    def every(self):
        return self.notes(self.spark.createDataFrame([(p,) for p in self.files], "rel_path string"))

    @staticmethod
    def links(notes):
        each = notes.where("wanted != '' AND parse_error IS NULL").select(F.col("cid").alias("source_cid"), F.explode(F.split("wanted", " ")).alias("target"))
        return each.select("source_cid", F.when(F.col("target").endswith(".md"), "markdown").otherwise("wiki").alias("kind"), "target")


def same(a, b, columns=None) -> bool:
    columns = columns or sorted(a.columns)
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    return key(a) == key(b)


def assert_as_rebuilt(spark, store, vault):
    version = store.latest()
    notes = vault.every()
    built = search.build(notes, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    kept = incremental.index(store, version)
    counts = search.integrity(kept).first()
    assert counts.missing == counts.extra == 0 and counts.total == built.postings.count()
    assert same(kept.notes, notes, sorted(notes.columns)) and same(kept.lengths, built.lengths)
    assert same(search.match(kept, 'gam* OR "alpha beta"'), search.match(built, 'gam* OR "alpha beta"'))
    assert same(search.match(kept, "alpha", "raw"), search.match(built, "alpha", "raw"))
    cids = notes.where("layer != 'raw'")
    whole = resolve.edges(vault.links(notes), cids.select("cid"), cids.where("parse_error IS NOT NULL"))
    assert same(incremental.links(store, version), whole)


def test_follows_changes(spark):
    store, vault = fresh(spark), Vault(spark)
    r = random.Random(4)
    words = "alpha beta gamma gamut delta".split()
    names = ["wiki/a", "wiki/b", "customers/a", "customers/x/c", "archive/c", "projects/b", "wiki/d e"]
    targets = ["a", "b", "c", "x/c", "wiki/a", "none", "./b.md", "../customers/a.md", "d e", "100%.md"]
    some = lambda of: " ".join(r.choices(of, k=r.randint(0, 5)))
    vault.put("raw/one.txt", "alpha raw")
    for n in names[:5]:
        vault.put(f"{n}.md", some(words), some(targets[:8]) if n != "wiki/b" else "a none")
    incremental.scan(store, vault.listing(), vault.notes, vault.links)
    assert sorted(vault.read_paths) == sorted(vault.files)
    for round in range(3):
        vault.read_paths = []
        changed = r.sample(names, 2)
        for n in changed:
            if round == 1 and f"{n}.md" in vault.files:
                del vault.files[f"{n}.md"]
            else:
                vault.put(f"{n}.md", some(words), some(targets), broken=round == 2 and n == changed[0])
        incremental.scan(store, vault.listing(), vault.notes, vault.links)
        assert set(vault.read_paths) <= {f"{n}.md" for n in changed}
        assert_as_rebuilt(spark, store, vault)
    before = store.latest().number
    vault.read_paths = []
    assert not incremental.pending(store, vault.listing())
    assert incremental.scan(store, vault.listing(), vault.notes, vault.links).number == before and not vault.read_paths
    merged = incremental.merge(store, every=True)
    assert merged.number == before + 1 and len(merged.facts["segments"]) == 1 and len(merged.folders("postings")) == 1
    assert_as_rebuilt(spark, store, vault)


def test_settings_reach_unchanged_files(spark):
    store, vault = fresh(spark), Vault(spark)
    for p, s in (("raw/a.log", ""), ("raw/b.txt", "text"), ("wiki/n.md", "note")):
        vault.put(p, "alpha", settings=s)
    incremental.scan(store, vault.listing(), vault.notes, vault.links)
    vault.read_paths = []
    t, body, wanted, broken, _ = vault.files["raw/a.log"]
    vault.files["raw/a.log"] = (t, body, wanted, broken, "text")  # .log is a text suffix now; the file is the same
    assert incremental.pending(store, vault.listing())
    incremental.scan(store, vault.listing(), vault.notes, vault.links)
    assert vault.read_paths == ["raw/a.log"] and not incremental.pending(store, vault.listing())


def test_many_scans_keep_few_segments(spark, monkeypatch):
    monkeypatch.setattr(incremental, "SEGMENTS", 2)
    store, vault = fresh(spark), Vault(spark)
    for i in range(6):
        vault.put(f"wiki/n{i % 4}.md", f"alpha gamma{i}", "n1 none")
        version = incremental.scan(store, vault.listing(), vault.notes, vault.links)
    assert len(version.facts["segments"]) <= 3
    assert_as_rebuilt(spark, store, vault)


def test_one_of_two_writers_works_again(spark):
    """Both change the table; the one who comes second starts from what the first published."""
    store, other = fresh(spark), None
    meet, order = threading.Barrier(2), []
    other = Snapshots(spark, store.where)

    def add(name: str, s: Snapshots):
        first = [True]

        def step(base, number):
            if first[0]:
                first[0] = False
                meet.wait(60)  # both have seen the same latest version
            order.append((name, base.number if base else 0))
            held = base.facts["names"] if base else []
            return Version(number, s.latest().tables if base else {}, {"names": [*held, name]})

        return lambda: s.update(step)

    threads = [threading.Thread(target=add(n, s)) for n, s in (("a", store), ("b", other))]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    last = store.latest()
    assert last.number == 2 and sorted(last.facts["names"]) == ["a", "b"] and len(order) == 3


def test_readers_see_whole_versions(spark):
    store = fresh(spark)
    one = store.update(lambda base, n: Version(n, {"t": (lambda s: (s[0], (s[1],)))(store.write(spark.range(5), "t"))}, {}))
    seen = store.read(one, "t")
    store.write(spark.range(100), "t")  # a writer that dies before it publishes
    assert store.latest() == one and seen.count() == 5
    store.update(lambda base, n: Version(n, {"t": (lambda s: (s[0], (s[1],)))(store.write(spark.range(7), "t"))}, {}))
    assert seen.count() == 5 and store.read(store.latest(), "t").count() == 7


def test_a_broken_manifest_is_built_again(spark):
    store, vault = fresh(spark), Vault(spark)
    vault.put("wiki/a.md", "alpha beta", "b")
    vault.put("wiki/b.md", "beta", "a")
    version = incremental.scan(store, vault.listing(), vault.notes, vault.links)
    path = f"{store.where}/versions/{version.number:012}.json"
    text = open(path).read()
    whole = json.loads(text)
    for broken in (text[:-9], text.replace('"notes"', '"nodes"', 1), json.dumps(whole | {"format": 0}), "\udcff\x00", "[]", ""):
        with open(path, "w", errors="surrogateescape") as f:
            f.write(broken)
        assert store.latest() is None and incremental.pending(store, vault.listing())
    vault.read_paths = []
    again = incremental.scan(store, vault.listing(), vault.notes, vault.links)
    assert again.number == version.number + 1 and sorted(vault.read_paths) == ["wiki/a.md", "wiki/b.md"]
    assert_as_rebuilt(spark, store, vault)


def test_a_store_of_sparks_own(spark, tmp_path):
    files = _Store(spark, f"file://{tmp_path}/versions")
    assert files.names() == [] and files.publish("000000000001.json", "{}")
    assert not files.publish("000000000001.json", "[]")
    assert files.text("000000000001.json") == "{}" and [n for n in files.names() if not n.startswith(".")] == ["000000000001.json"]
    assert not [n for n in os.listdir(tmp_path / "versions") if n.endswith(".json") and n.startswith(".0")]


def test_settings_in_a_delta(spark):
    old = spark.createDataFrame([("a", 1.0, 2, "x"), ("b", 1.0, 2, "x"), ("c", 1.0, 2, None)], "rel_path string, mtime double, file_size long, settings string")
    new = spark.createDataFrame([("a", 1.0, 2, "y"), ("b", 1.0, 2, "x"), ("c", 1.0, 2, None), ("d", 1.0, 2, "x")], old.schema)
    assert {r.rel_path: r.change for r in delta.classify(old, new).collect()} == {"a": "update", "b": "same", "c": "same", "d": "insert"}
    assert {r.change: r.n for r in delta.pending(old, new).collect()} == {"update": 1, "same": 2, "insert": 1}
