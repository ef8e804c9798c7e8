"""Folders of files: sources, settings, retrieval, search, audit and writes on written cases."""

import subprocess

import pytest
from pyspark.sql import functions as F

from marginalia.functions import frontmatter as fm
from marginalia.functions import markdown, scalar
from marginalia.functions.text import cut_at_words
from marginalia.operators import audit, graph, ground, quality, resolve, search
from marginalia.sources import files, notes, vault, writer


def put(root, path, text):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("collection")
    put(top, "wiki/hub.md", "---\ntype: moc\ntitle: Hub\ndescription: All\nstatus: active\n---\n# Hub\n[[pods]] and [[C#-Basics]], [[gone]].\n")
    put(top, "wiki/pods.md", "---\ntype: guide\ntitle: Pods\ndescription: Kubelet\nstatus: active\naliases:\n  - HTN\n  - htn\nsources:\n  - ./raw/a.txt\n  - raw/x/../b.pdf\n  - raw/none\n---\n# Pods\nPods stuck in CrashLoopBackOff after running.\n## Part\nOne [[hub|The Hub]].\n## Other\nTwo.\n")
    put(top, "wiki/_draft.md", "---\ntype: concept\ntitle: Words\ndescription: Backoff\nstatus: draft\n---\nThe runtime enters a crash loop back off delay.\n")
    put(top, "wiki/C#-Basics.md", "---\ntype: concept\ntitle: C\ndescription: D\nstatus: active\n---\n# Intro\nSharp.\n")
    put(top, "projects/AGENTS.md", "---\nallowed_types:\n  - note\nrequire_sources: true\n---\nBe brief.\n")
    put(top, "projects/broken.md", "---\ntitle: [x]\n---\nBody")
    put(top, "Templates/t.md", "---\ntitle: T\n---\nTemplate body")
    put(top, ".hid/x.md", "hidden")
    put(top, "raw/a.txt", "raw text\n## Part\nmore\n")
    put(top, "raw/b.pdf", "%PDF")
    put(top, "raw/.git/c.txt", "hidden")
    (top / "raw/out.txt").symlink_to("/etc/hostname")
    return top


@pytest.fixture(scope="module")
def tables(spark, root):
    rows = notes.notes(notes.files(spark, str(root), "Templates")).cache()
    raw = notes.raw(files.collection(spark, str(root), "raw"), list(vault.TEXT_SUFFIXES)).cache()
    written = notes.note_links(rows).where("kind = 'wiki'").withColumn("target_raw", F.split_part("target_raw", F.lit("#"), F.lit(1)))
    links = resolve.resolve(notes.note_links(rows).where("kind = 'wiki'").drop("target_raw").withColumnRenamed("target", "target_raw"), rows.select("cid"))
    assert written.count() == links.count()
    return rows, raw, links, notes.note_sources(rows, raw)


def test_files(tables):
    rows, raw, links, sources = tables
    got = {r.cid: r for r in rows.collect()}
    assert set(got) == {"wiki/hub", "wiki/pods", "wiki/_draft", "wiki/C#-Basics", "projects/broken"}
    assert got["wiki/pods"].aliases == "HTN" and "crashloop" in got["wiki/pods"].subwords.split()
    assert got["projects/broken"].parse_error and got["projects/broken"].parse_line == 2
    found = {r.rel_path: r for r in raw.collect()}
    assert set(found) == {"raw/a.txt", "raw/b.pdf"} and found["raw/b.pdf"].body == "" and found["raw/a.txt"].body.startswith("raw text")
    assert {(r.raw_path, r.resolved_path) for r in sources.collect()} == {("./raw/a.txt", "raw/a.txt"), ("raw/x/../b.pdf", "raw/b.pdf"), ("raw/none", None)}
    assert {(r.source_cid, r.target_raw, r.target_cid, r.alias) for r in links.collect()} == {("wiki/hub", "pods", "wiki/pods", None), ("wiki/hub", "C", None, None), ("wiki/hub", "gone", None, None), ("wiki/pods", "hub", "wiki/hub", "The Hub")}


def test_search(spark, tables, tmp_path):
    rows, raw, _, _ = tables
    index = search.build(rows.unionByName(raw.drop("file_hash"), allowMissingColumns=True), str(tmp_path / "index"))
    hits = lambda q, **by: [r.cid for r in search.search(index, q, **by).collect()]
    for query in ("crashloop", "backoff", "crash loop", "run", "HTN"):
        assert "wiki/pods" in hits(query), query
    assert hits("CrashLoopBackOff") == ["wiki/pods", "wiki/_draft"] and hits("raw") == [] and hits("raw", domain="raw") == ["raw/a.txt"]
    assert hits("!!!") == [] and hits("") and search.top(index, "!!!").count() == 0 and search.match(index, "--").count() == 0
    assert [tuple(r) for r in search.integrity(search.load(spark, str(tmp_path / "index"))).select("missing", "extra").collect()] == [(0, 0)]
    shown = search.snippets(search.top(index, "stuck pods"), index.notes, "stuck pods", 3).collect()
    assert [r.snippet for r in shown] == ["# <b>Pods</b>\n<b>Pods</b> <b>stuck</b>..."]
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            search.search(index, "x", bad)


def test_cut_at_words():
    which = lambda w: {"b": 0, "d": 1}.get(w)
    assert cut_at_words("a b c, d e f", which, 3) == "...<b>b</b> c, <b>d</b>..." and cut_at_words("a b", which, 5) == "a <b>b</b>"
    assert cut_at_words("", which, 3) == "" and cut_at_words("x y z w", which, 2) == "x y..." and cut_at_words("...", which, 2) == "..."


def test_ground(tables):
    rows, raw, links, sources = tables
    texts = raw.select("rel_path", "body", F.col("rel_path").endswith(".txt").alias("is_text"))
    get = lambda *t, **k: ground.ground(rows, links, sources, texts, list(t), **k)
    one, two, three, four, five = get("[[pods#part]]", "wiki/C#-Basics.md", "raw/A.txt#Part", "raw/b.pdf", "nothing", directives={"wiki": "Flat."})
    assert (one["cid"], one["section"], one["content"], one["directives"]) == ("wiki/pods", "Part", "## Part\nOne [[hub|The Hub]].\n", "Flat.")
    assert [x["cid"] for x in one["backlinks"]] == ["wiki/hub"] and [x["title"] for x in one["links"]] == ["Hub"] and len(one["sources"]) == 3
    assert two["cid"] == "wiki/C#-Basics" and three["path"] == "raw/a.txt" and three["content"] == "## Part\nmore\n" and three["cited_by"] == ["wiki/pods"]
    assert four["filename_only"] and four["content"] is None and five["error"]["code"] == "NOT_FOUND"
    assert "section_error" in get("pods#none")[0] and get("pods", tokens=10)[0]["truncated"]
    for bad in ([], "pods", ["x"] * 51):
        with pytest.raises(ValueError):
            ground.ground(rows, links, sources, texts, bad)
    with pytest.raises(LookupError):
        get("nothing")


def test_names(tables):
    rows, _, links, _ = tables
    assert graph.resolve_cid(rows, "WIKI/PODS.md") == graph.resolve_cid(rows, "[[pods|x]]") == "wiki/pods"
    assert [r.cid for r in graph.suggestions(rows, "x/Pods").collect()] == ["wiki/pods"]
    around = {(r.kind, r.cid, r.n, r.total) for r in graph.view(rows, links, "neighborhood", "wiki/pods").collect()}
    assert around == {("forward", "wiki/hub", 1, 1), ("back", "wiki/hub", 1, 1)}
    assert [r.cid for r in graph.view(rows, links, "unfiled").collect()] == ["wiki/C#-Basics", "wiki/_draft"]
    for bad in (("none", None, 5), ("hubs", "x", 5), ("neighborhood", None, 5), ("hubs", None, 0)):
        with pytest.raises(ValueError):
            graph.view(rows, links, *bad)


def test_settings_and_domains(spark, root, monkeypatch):
    found = vault.settings('{"ranking": {"trust": {"unverified": 0.5}}, "later": 1}')
    assert found["ranking"]["trust"]["unverified"] == 0.5 and found["ranking"]["trust"]["human-reviewed"] == 2.0 and found["later"] == 1
    for bad in ("[]", "{", '{"integrity": "x"}', '{"log_rotate_bytes": true}', '{"ranking": {"trust": {"a": NaN}}}', '{"identities": {"a": "b"}}', '{"raw_text_extensions": [1]}', '{"ranking": []}'):
        with pytest.raises(vault.SettingsError):
            vault.settings(bad)
    domains = {d.name: d for d in vault.discover(root, "Templates")}
    assert set(domains) == {"wiki", "projects"} and domains["projects"].allowed_types == ["note"] and domains["projects"].directives == "Be brief."
    assert vault.domain("x", "---\ndomain: y\n---\n").manifest_error and quality.manifests(vault.domain_table(spark, [vault.domain("x", "---\nz")])).count() == 1
    assert vault.find_root(str(root / "wiki")) == root.resolve() and vault.template(root, "Templates", "t") == "Template body"
    for bad in ("../wiki/hub", "/etc/x", ""):
        with pytest.raises(ValueError):
            vault.template(root, "Templates", bad)
    monkeypatch.setenv(vault.ROOT_VARIABLE, "/nowhere")
    with pytest.raises(vault.SettingsError):
        vault.find_root()


def test_audit(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=ann@x.org", *args], cwd=tmp_path, check=True, capture_output=True)

    entry = "---\nverified:\n  - by: human:{}\n    at: 2024-01-01T00:00:00Z # day\n---\nBody\n"
    git("init")
    put(tmp_path, "wiki/a.md", entry.format("ann"))
    put(tmp_path, "wiki/b.md", entry.format("bob"))
    git("add", ".")
    git("commit", "-m", "x")
    put(tmp_path, "wiki/a.md", entry.format("ann").replace("2024", "2025"))
    put(tmp_path, "wiki/c.md", entry.format("ann"))
    put(tmp_path, "wiki/d.md", "---\nx: [\nverified:\n  - by: agent:z\n---\n")
    found = audit.entries(notes.files(spark, str(tmp_path)))
    people = spark.createDataFrame([("human:ann", "ann@x.org"), ("human:bob", "bob@x.org")], "actor string, email string")
    blamed = audit.blame(spark, str(tmp_path), found)
    got = {(r.rel_path, r.line): r.message for r in audit.audit(found, blamed, people).collect()}
    assert set(got) == {("wiki/a.md", 4), ("wiki/b.md", 3), ("wiki/c.md", 3)}
    assert "committed" in got["wiki/a.md", 4] and "ann@x.org" in got["wiki/b.md", 3] and "history" in got["wiki/c.md", 3]
    git("add", ".")
    git("commit", "-m", "y")
    signed = audit.audit(found, audit.blame(spark, str(tmp_path), found), people, spark.createDataFrame([], "commit string, status string")).collect()
    assert {(r.rel_path, r.code) for r in signed} == {("wiki/a.md", "UNSIGNED_ENDORSEMENT"), ("wiki/b.md", "PROVENANCE_MISMATCH"), ("wiki/c.md", "UNSIGNED_ENDORSEMENT")}


def test_writes(spark, tmp_path):
    me = "agent:bot"
    put(tmp_path, "projects/AGENTS.md", "---\nallowed_types:\n  - note\n---\n")
    cid = writer.scaffold(tmp_path, "First -- Note!", "guide", "What: it's \"quoted\" # not a comment", me, aliases=["A"])
    assert cid == "wiki/first-note" and writer.listed(tmp_path) == [cid]
    header, body, had = writer.read(tmp_path, cid)
    assert header["description"] == "What: it's \"quoted\" # not a comment" and header["status"] == "draft" and body == "# First -- Note!\n"
    for bad in (dict(domain="projects"), dict(path="../x"), dict(path="raw/x"), dict(path="wiki/a/b"), dict(path="wiki/a|b"), dict(path="/x"), dict(status="odd"), dict(aliases=["a\nb"])):
        with pytest.raises(ValueError):
            writer.scaffold(tmp_path, "X", "guide", "d", me, **bad)
    with pytest.raises(FileExistsError):
        writer.scaffold(tmp_path, "x", "guide", "d", me, path="wiki/FIRST-note")
    with pytest.raises(writer.Refused):
        writer.scaffold(tmp_path, "y", "guide", "d", me, takes_over=lambda c: ["z"])
    new = writer.update(tmp_path, cid, me, {"status": "active", "aliases": None}, {"Part": "Text."}, [("Text", "More text")], had)
    assert writer.read(tmp_path, cid)[1] == "# First -- Note!\n\n## Part\n\nMore text.\n" and "aliases" not in writer.read(tmp_path, cid)[0]
    for bad in (dict(expected=had, patch={"title": "t"}), dict(patch={"title": "First -- Note!"}), dict(replace=[("none", "x")]), dict(patch={"verified": []})):
        with pytest.raises((ValueError, FileExistsError, writer.Refused)):
            writer.update(tmp_path, cid, me, **bad)
    assert writer.verify(tmp_path, cid, "human:ann") and not writer.verify(tmp_path, cid, "human:ann") and writer.read(tmp_path, cid)[2] != new
    with pytest.raises(writer.Refused):
        writer.verify(tmp_path, cid, me, "source-crosscheck")
    row = notes.notes(notes.files(spark, str(tmp_path))).where(F.col("cid") == cid).first()
    assert row.trust_tier == "human-reviewed" and row.body_hash == writer.body_hash(row.body)
    put(tmp_path, "wiki/b.md", "---\ntype: x\n---\n[[first-note#Part|x]] `[[first-note]]` [y](first-note.md) [[other]]\n")
    moves, edits = {cid: "projects/moved"}, {"wiki/b": {"first-note": "moved", "first-note.md": "../projects/moved.md"}}
    with pytest.raises(writer.Refused):
        writer.apply_move(tmp_path, moves, edits, me, "other")
    writer.apply_move(tmp_path, moves, edits, me)
    assert (tmp_path / "wiki/b.md").read_text().endswith("[[moved#Part|x]] `[[first-note]]` [y](../projects/moved.md) [[other]]\n")
    assert sorted(writer.listed(tmp_path)) == ["projects/moved", "wiki/b"]
    with pytest.raises(FileExistsError):
        writer.apply_move(tmp_path, {"wiki/b": "projects/moved"}, {}, me)
    said = (tmp_path / "log/ledger.md").read_text().split("\n")
    assert [x.split()[3] for x in said if x] == ["scaffold", "update", "verify", "move"]
    writer.record(tmp_path, me, "a\nb", limit=10)
    assert (tmp_path / "log/ledger.md").read_text().count("\n") == 1 and len(list((tmp_path / "log").glob("ledger-*.md"))) == 1
    with pytest.raises(ValueError):
        writer.record(tmp_path, "nobody", "x")
    (tmp_path / "log/.lock").write_text("1")
    with pytest.raises(TimeoutError), writer.lock(tmp_path, wait=0.1):
        pass
    with writer.lock(tmp_path, wait=1, stale=0):
        pass


def test_headers_are_strict():
    parsed = fm.parse("a: 42\nb: true\nc: True\nd: ~\ne:\nf: null\ng: 'it''s'\nh: \"x\\ty\"\ni: http://x # c")
    assert parsed == {"a": "42", "b": True, "c": "True", "d": "~", "f": None, "g": "it's", "h": "x\ty", "i": "http://x"}
    for bad in ("a: b [c]", "a: {}", 'a: "\\u0041"', "a: 'x", "- a", "a:\n  - x\n  - k: v", "a:\n  b: c\n  - d", "a:\n  b:\n", "a:\n    b: c", "a: &x", "a:\n  - - b"):
        with pytest.raises(fm.HeaderError):
            fm.parse(bad)
    for bad in ("---\na: b\n", "---\na: b\rc: d\n---\n"):
        with pytest.raises(fm.HeaderError):
            fm.split(bad)
    for value in ("", " x", "- a", "a: b", "true", "~", "a # b", "it's", '"', "[x]", "x\ty\nz", "\\", "null", "é", "a:"):
        assert fm.parse(f"k: {fm.written(value)}")["k"] == value, value


def test_sections_keep_their_heading():
    assert markdown.with_section("a\n## Intro ##\nold\n## B\n", "Intro", "new") == "a\n## Intro ##\n\nnew\n\n## B\n"
    assert markdown.with_section("a", "B", "c") == "a\n\n## B\n\nc\n" and markdown.with_section(None, "## B", "c") == "## B\n\nc\n"


def test_stems_of_files(spark):
    rows = spark.createDataFrame([("  Größe -- (x)_y ",), ("!!!",), ("A__B",)], "t string")
    assert [r[0] for r in rows.select(scalar.file_stem(F.col("t"))).collect()] == ["größe-x-y", "untitled", "a-b"]


def test_writes_keep_bytes_modes_and_places(tmp_path):
    from marginalia.sources import writer

    (tmp_path / "wiki").mkdir()
    odd = "---\ntitle: A\n---\nCaf\xe9 [[b]]\n".encode("latin-1")
    (tmp_path / "wiki/a.md").write_bytes(odd)
    (tmp_path / "wiki/a.md").chmod(0o664)
    (tmp_path / "wiki/b.md").write_text("---\ntitle: B\n---\nText\n")
    writer.apply_move(tmp_path, {"wiki/a": "wiki/c", "wiki/b": "projects/b"}, {"wiki/a": {"b": "projects/b"}}, "human:ann")
    assert (tmp_path / "wiki/c.md").read_bytes() == odd.replace(b"[[b]]", b"[[projects/b]]")
    assert (tmp_path / "wiki/c.md").stat().st_mode & 0o777 == 0o664
    with pytest.raises(writer.Refused):
        writer.update(tmp_path, "wiki/c", "human:ann", {"title": "X"})
    outside = tmp_path.parent / f"{tmp_path.name}-outside"
    outside.mkdir()
    (tmp_path / "linked").symlink_to(outside)
    with pytest.raises(writer.Refused):
        writer.scaffold(tmp_path, "T", "note", "D", "human:ann", domain="linked")
    assert not list(outside.iterdir())
    for bad in ("wiki/a<b", "wiki/ a", "projects/raw/x", "projects/x`y"):
        with pytest.raises(ValueError):
            writer.place(tmp_path, "T", path=bad)


def test_a_failed_move_puts_odd_bytes_back(tmp_path, monkeypatch):
    from marginalia.sources import writer

    for name in "ab":
        (tmp_path / "wiki").mkdir(exist_ok=True)
        (tmp_path / f"wiki/{name}.md").write_bytes(b"\xe9 [[x]]")
    real, calls = writer.write, []

    def failing(path, data, expected=None):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("disk full")
        real(path, data, expected)

    monkeypatch.setattr(writer, "write", failing)
    with pytest.raises(OSError, match="disk full"):
        writer.apply_move(tmp_path, {"wiki/a": "wiki/z"}, {"wiki/b": {"x": "y"}}, "human:ann")
    assert sorted(p.name for p in (tmp_path / "wiki").iterdir()) == ["a.md", "b.md"]
    assert (tmp_path / "wiki/a.md").read_bytes() == (tmp_path / "wiki/b.md").read_bytes() == b"\xe9 [[x]]"


def test_a_lock_takes_no_other_away(tmp_path):
    from marginalia.sources import writer

    path = tmp_path / "log" / ".lock"
    with writer.lock(tmp_path):
        path.unlink()
        path.write_text("1 another")  # another holder's, come after ours was broken
    assert path.read_text() == "1 another"
    path.write_text("999999999 gone")
    with writer.lock(tmp_path, wait=1):
        assert path.read_text() != "999999999 gone"
    assert not path.exists()


def test_raw_links_and_their_hints(spark):
    links = spark.createDataFrame([("wiki/n.md", "../raw/a.txt"), ("wiki/n.md", "raw/a.txt"), ("wiki/n.md", "../../raw/x/b%20c.pdf"), ("wiki/n.md", "../raw/none.txt#p"), ("projects/p/n.md", "../raw/x/b%20c.pdf"), ("wiki/n.md", "a.md")], "rel_path string, target_raw string")
    raw = spark.createDataFrame([("raw/a.txt",), ("raw/x/b c.pdf",)], "path string")
    got = {(r.rel_path, r.message) for r in quality.broken_raw_links(links, raw).collect()}
    assert got == {
        ("wiki/n.md", "No raw file 'raw/a.txt'; did you mean '../raw/a.txt'?"),
        ("wiki/n.md", "No raw file '../../raw/x/b%20c.pdf'; did you mean '../raw/x/b%20c.pdf'?"),
        ("wiki/n.md", "No raw file '../raw/none.txt#p'"),
        ("projects/p/n.md", "No raw file '../raw/x/b%20c.pdf'; did you mean '../../raw/x/b%20c.pdf'?"),
    }
