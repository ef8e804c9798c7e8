"""The boolean query language: cleaning a query string and parsing it to a tree.

Precedence is NOT over AND over OR; words that follow one another are joined by
an AND that binds like AND.  A word that holds other characters than letters and
digits is a phrase of its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from marginalia.functions.text import camel_parts, tokens_of

OPERATORS = ("AND", "OR", "NOT")
#: Words that a partial match doesn't look for.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")


@dataclass(frozen=True)
class Leaf:
    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Node:
    op: str
    left: Node | Leaf
    right: Node | Leaf


Tree = Node | Leaf


def _lexemes(query: str) -> Iterator[tuple[str, bool, bool]]:
    """(text, whether quoted, whether a prefix); an open quote runs to the end."""
    at = 0
    while at < len(query):
        if query[at].isspace():
            at += 1
            continue
        quoted = query[at] == '"'
        start = at + quoted
        at = start
        while at < len(query) and query[at] != '"' and (quoted or not query[at].isspace()):
            at += 1
        text = query[start:at]
        at += quoted
        star = query.startswith("*", at) if quoted else len(text) > 1 and text.endswith("*")
        at += quoted and star
        yield (text.strip() if quoted else text[: len(text) - star]), quoted, star


def clean(query: str) -> list[str]:
    """Operators and operands in order, with every operator between two operands.  Phrases keep their quotes."""
    out: list[str] = []
    waiting = ""  # the operator since the last operand
    for text, quoted, star in _lexemes(query):
        if text in OPERATORS and not quoted and not star:
            waiting = "NOT" if waiting == "AND" and text == "NOT" else waiting or text
        elif any(c.isalnum() for c in text):
            out += [waiting] * bool(waiting and out)
            whole = f'"{text}"' if quoted or re.search(r"\W", text) else text
            out.append(whole + "*" * star)
            waiting = ""
        if not out:
            waiting = ""
    return out


def parse(parts: list[str]) -> Tree | None:
    """The tree of a cleaned query; None where no operand has a token."""

    def leaf(part: str) -> Leaf | None:
        words = tuple(tokens_of(part.rstrip("*").strip('"')))
        return Leaf(words, part.endswith("*")) if words else None

    def join(op: str, nodes: list[Tree | None]) -> Tree | None:
        tree = None
        for n in nodes:
            tree = n if tree is None else tree if n is None else Node(op, tree, n)
        return tree

    def split(items: list[str], op: str) -> list[list[str]]:
        groups: list[list[str]] = [[]]
        for x in items:
            if x == op:
                groups.append([])
            else:
                groups[-1].append(x)
        return groups

    def of_nots(items: list[str]) -> Tree | None:
        return join("NOT", [leaf(g[0]) for g in split(items, "NOT") if g])

    def of_ands(items: list[str]) -> Tree | None:
        nodes: list[Tree | None] = []
        for group in split(items, "AND"):
            run: list[str] = []
            for x in group:
                if run and x != "NOT" and run[-1] != "NOT":
                    nodes.append(of_nots(run))
                    run = []
                run.append(x)
            nodes.append(of_nots(run))
        return join("AND", nodes)

    return join("OR", [of_ands(g) for g in split(parts, "OR")]) if parts else None


def leaves(tree: Tree) -> list[Leaf]:
    return [tree] if isinstance(tree, Leaf) else [*leaves(tree.left), *leaves(tree.right)]


def split_camel(parts: list[str]) -> list[str] | None:
    """The query with mixed-case words as their parts; None where nothing splits or operators are given."""
    if any(p in OPERATORS for p in parts):
        return None
    out = [x for p in parts for x in (p if p[0] == '"' else None) and [p] or camel_parts(p.rstrip("*")) or [p]]
    return out if out != parts else None


def any_of(parts: list[str]) -> list[str] | None:
    """The query with its different words joined by OR, stop words left out; None for one word or given operators."""
    if len(parts) < 2 or any(p in OPERATORS for p in parts):
        return None
    distinct = list({p.casefold(): p for p in reversed(parts)}.values())[::-1]
    content = [p for p in distinct if p.casefold() not in STOP_WORDS]
    if len(distinct) < 2 or not content:
        return None
    return [x for p in content for x in ("OR", p)][1:]
