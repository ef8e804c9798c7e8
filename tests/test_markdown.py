"""Markdown, headers and the file source on written cases."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.functions import frontmatter as fm
from marginalia.functions import markdown as md
from marginalia.sources import notes


def test_fences_and_headings():
    text = "# A\n````\n# no\n```\n## no\n````\n## B `x` ##\n~~~\n# open\n"
    assert md.headings(text) == [(1, "A"), (2, "B x")]
    assert md.headings("# C#\n#none\n####### seven\n#\nline") == [(1, "C#")]
    assert md.headings(None) == md.headings("") == []


def test_links():
    text = "[[a#h|x]] ![[b]] ![[c.png]] `[[no]]` [[t\\|al]] [m](<d e.md#s%20t> \"title\") ![i](p.png) [u](https://x.y) [j](#z) [r](/abs.md)\n$[[math]]$\n[ref]: q.md\n[^1]: note.md"
    found = [(x.kind, x.target, x.anchor, x.alias, x.embed) for x in md.links(text)]
    assert found == [("wiki", "a", "h", "x", False), ("wiki", "b", None, None, True), ("wiki", "t", None, "al", False), ("markdown", "d e.md", "s t", None, False)]
    assert [x.target for x in md.links(text, paths=True) if x.kind in ("image", "definition")] == ["p.png", "q.md"]
    for x in md.links(text):
        assert text[x.start : x.end] == x.target
    assert [md.is_edge(x) for x in md.links("[a](raw/x.md) [b](c.txt) [d](e.md)")] == [False, False, True]


def test_sections():
    text = "pre\n## A\n1\n### N\n2\n## B\r\n3"
    assert md.sections(text) == [("", "pre\n"), ("A", "## A\n1\n### N\n2\n"), ("B", "## B\r\n3")]
    assert md.section(text, "a") == ("A", "## A\n1\n### N\n2\n")
    assert md.section(text, "n") == ("N", "### N\n2\n")
    assert md.section(text, "none") is None and md.section(text, None) is None and md.section(None, "a") is None
    assert md.with_section(text, "## A", "new") == "pre\n## A\n\nnew\n\n## B\r\n3"
    assert md.with_section(text, "a", "new").endswith("3\n\n## a\n\nnew\n")
    assert md.supplements("```\n> [!WARNING] Unverified Supplement\n```\n> [!warning]- Unverified supplement (x)\n") == [4]


@settings(max_examples=150, deadline=None)
@given(st.text("#` \n~a[]|", max_size=80))
def test_lossless(text):
    assert "".join(x.text for x in md.outline(text)) == text
    assert "".join(s for _, s in md.sections(text)) == text
    assert len(md.without_code(text)) == len(text)


def test_budget():
    text = "## A\n" + "x" * 50 + "\n## B\n" + "y" * 50
    assert md.within_budget(text, None) == (text, 2, 2)
    assert md.within_budget(text, 1000)[0] == text
    cut, kept, total = md.within_budget(text, 20)
    assert (kept, total) == (1, 2) and cut == "## A\n" + "x" * 50 + "\n\n> [truncated: 1 of 2 sections included]\n"
    assert md.within_budget("z" * 400, 50)[1:] == (0, 1)


@pytest.mark.parametrize("text", ["`" * 50_000, "[[" * 40_000, "[" * 60_000, "# " + " " * 60_000 + "x", "$" * 50_000, "![" * 30_000, "``` `" * 20_000])
def test_long_texts_stay_fast(text):
    start = time.perf_counter()
    list(md.links(text, paths=True)), md.headings(text), md.sections(text)
    assert time.perf_counter() - start < 3


def test_header():
    text = "---\ntitle: 'It''s' # c\nn: 3\nok: true\nnone:\ntags:\n  - a\n  - \"b # c\"\nverified:\n  - by: human:ann\n    at: 2024-01-01T00:00:00Z\nmap:\n  k: 1.5\n---\nbody\n---\n"
    header, body = fm.split(text)
    assert body == "body\n---\n"
    fields = fm.parse(header)
    assert fields == {"title": "It's", "n": "3", "ok": True, "tags": ["a", "b # c"], "verified": [{"by": "human:ann", "at": "2024-01-01T00:00:00Z"}], "map": {"k": "1.5"}}
    assert fm.parse(fm.serialize(fields)) == fields
    assert fm.split("no header") == (None, "no header") and fm.split(None) == (None, "")


@pytest.mark.parametrize("header, line", [("a: 1\na: 2", 2), ("a: 1\n\tb: 2", 2), ("a: [1]", 1), ("a: &x 1", 1), ("a: |", 1), ("a: 1\n   b: 2", 2), ("just text", 1), ("- a", 1), ('a: "open', 1)])
def test_header_errors(header, line):
    with pytest.raises(fm.HeaderError) as e:
        fm.parse(header)
    assert e.value.line == line


#: What a header can hold: no carriage return, and no half of a character.
TEXT = st.text(st.characters(exclude_characters="\r", exclude_categories=("Cs",)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.from_regex(r"\A[a-z]{1,6}\Z"), st.one_of(st.none(), st.booleans(), TEXT, st.lists(TEXT, min_size=1, max_size=3), st.just({"by": "a: b"}), st.just([{"by": "x", "n": "1"}])), max_size=5))
def test_header_round_trip(fields):
    assert fm.parse(fm.serialize(fields)) == fields


def test_source(spark, tmp_path):
    (tmp_path / "wiki").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "wiki/a.md").write_text("---\ntitle: A\ntags:\n  - t\n---\nSee [[b#x]] and [[b#x]], [c](../wiki/c.md).\n")
    (tmp_path / "wiki/b.md").write_text("no header")
    (tmp_path / ".git/x.md").write_text("hidden")
    rows = notes.notes(notes.files(spark, str(tmp_path)))
    got = {r.cid: r for r in rows.collect()}
    assert set(got) == {"wiki/a", "wiki/b"}
    assert (got["wiki/a"].title, got["wiki/a"].tag_list, got["wiki/a"].trust_tier) == ("A", ["t"], "unverified")
    assert (got["wiki/b"].parse_error, got["wiki/b"].parse_line, got["wiki/b"].body) == ("no header", 1, "no header")
    links = {(r.target_raw, r.occurrences) for r in notes.note_links(rows).collect()}
    assert links == {("b#x", 2), ("../wiki/c.md", 1)}
