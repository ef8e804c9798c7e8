"""The header of a note: a strict, small subset of YAML between two lines of three hyphens.

Keys hold scalars, lists of scalars, mappings of scalars, or lists of mappings of
scalars.  Indents are 0, 2 and 4.  Bare `true`, `false` and `null` are what they
say; every other bare value is a string.  Tabs, flow values, anchors, tags, block
scalars, repeated keys and mixed lists are errors that name their line.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The words that aren't strings, the characters that a backslash gives in double quotes, and what opens no bare value.
WORDS = {"null": None, "true": True, "false": False}
ESCAPES = {"\\": "\\", '"': '"', "n": "\n", "t": "\t"}
REFUSED = {"&": "anchors", "*": "anchors", "!": "tags", "|": "block scalars", ">": "block scalars"}
_NAME = re.compile(r"[A-Za-z0-9_-]+")


class HeaderError(ValueError):
    def __init__(self, line: int, reason: str):
        super().__init__(reason)
        self.line, self.reason = line, reason


def split(text: str | None) -> tuple[str | None, str]:
    """(header, body); the header is None where the text has none.  HeaderError where it doesn't end, or holds a lone carriage return."""
    text = (text or "").removeprefix("\ufeff")
    first, feed, rest = text.partition("\n")
    if first.removesuffix("\r") != "---" or not (feed or first == "---"):
        return None, text
    lines = rest.split("\n")
    end = next((i for i, x in enumerate(lines) if x.strip() == "---"), None)
    if end is None:
        raise HeaderError(0, "the header doesn't end")
    for i, x in enumerate(lines[: end + 1], 1):
        if "\r" in x.removesuffix("\r"):
            raise HeaderError(i, "carriage return within a line")
    return "\n".join(x.removesuffix("\r") for x in lines[:end]), "\n".join(lines[end + 1 :])


def _uncommented(line: str) -> str:
    """Without a comment: a # at the start or after a space, outside quotes, which open only where a value starts."""
    begins, quote, skip = re.match(r"( *)((?:- *)?)((?:[A-Za-z0-9_-]+: *)?)", line), "", False
    opening = {begins.end(k) for k in (1, 2, 3)}
    for i, c in enumerate(line):
        if skip:
            skip = False
        elif quote:
            skip = c == "\\" and quote == '"'
            quote = "" if c == quote else quote
        elif c in "\"'" and i in opening:
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
    return line.rstrip()


def _unescaped(inner: str, line: int) -> str:
    out, at = [], 0
    while at < len(inner):
        c = inner[at]
        if c == '"':
            raise HeaderError(line, "quote within a double-quoted value")
        if c == "\\":
            at += 1
            if inner[at : at + 1] not in ESCAPES or at == len(inner):
                raise HeaderError(line, "unknown escape in a double-quoted value")
            c = ESCAPES[inner[at]]
        out.append(c)
        at += 1
    return "".join(out)


def scalar(written: str, line: int = 1) -> str | bool | None:
    text = written.strip()
    if text[:1] in ('"', "'"):
        if len(text) < 2 or text[-1] != text[0]:
            raise HeaderError(line, "a quoted value doesn't end")
        if text[0] == '"':
            return _unescaped(text[1:-1], line)
        if "'" in text[1:-1].replace("''", ""):
            raise HeaderError(line, "quote within a single-quoted value")
        return text[1:-1].replace("''", "'")
    if text[:1] in REFUSED:
        raise HeaderError(line, f"{REFUSED[text[0]]} aren't part of a header")
    if any(c in text for c in "[]{}"):
        raise HeaderError(line, "flow values aren't part of a header")
    return WORDS.get(text, text)


def _member(text: str) -> tuple[str, str] | None:
    """(key, value) of a colon that ends the text or has a space after it."""
    key, colon, value = text.partition(":")
    return (key.strip(), value.strip()) if colon and value[:1] in ("", " ") else None


def parse(header: str) -> dict[str, Any]:
    """The header's mapping; HeaderError with a line (from 1) otherwise.  A key without a value or members isn't in it."""
    out: dict[str, Any] = {}
    seen: set[str] = set()
    opened, entry = None, None  # the top-level key that waits for members, and the mapping that a list's last item began

    def named(member: tuple[str, str] | None, n: int) -> tuple[str, str]:
        if member is None or not _NAME.fullmatch(member[0]):
            raise HeaderError(n, "neither a key nor a list item")
        return member

    for n, raw in enumerate(header.split("\n"), 1):
        line = _uncommented(raw.rstrip("\r"))
        if "\t" in raw:
            raise HeaderError(n, "tab in a header")
        body = line.lstrip(" ")
        if not body:
            continue
        indent = len(line) - len(body)
        if indent == 0:
            key, value = named(_member(body), n)
            if key in seen:
                raise HeaderError(n, f"key {key} stands twice")
            seen.add(key)
            opened, entry = (None if value else key), None
            if value:
                out[key] = scalar(value, n)
        elif indent not in (2, 4) or opened is None:
            raise HeaderError(n, "indent out of place")
        elif indent == 2 and (body == "-" or body.startswith("- ")):
            item = body[1:].strip()
            member = None if item[:1] in ('"', "'") else _member(item)
            listed = out.setdefault(opened, [])
            if item.startswith("-") or not isinstance(listed, list) or (listed and isinstance(listed[0], dict) != bool(member)):
                raise HeaderError(n, "list item out of place")
            entry = None
            if member:
                key, value = named(member, n)
                entry = {key: scalar(value, n)}
            listed.append(entry if member else scalar(item, n))
        else:
            into = entry if indent == 4 else out.setdefault(opened, {})
            key, value = named(_member(body), n)
            if not isinstance(into, dict) or not value:
                raise HeaderError(n, "indent out of place" if value else "a mapping within a mapping")
            if key in into:
                raise HeaderError(n, f"key {key} stands twice")
            into[key] = scalar(value, n)
    return out


def written(value: Any) -> str:
    """A scalar that `scalar` reads back as the same value; numbers read back as their text."""
    for word, meaning in WORDS.items():
        if value is meaning:
            return word
    text = str(value)
    if "\r" in text:
        raise ValueError("a header holds no carriage return")
    try:
        bare = text not in WORDS and scalar(text) == text and _uncommented(text) == text and _uncommented(f"k: {text}") == f"k: {text}" and _member(text) is None
    except HeaderError:
        bare = False
    if bare and text and text == text.strip() and text.isprintable() and text[0] != "-":
        return text
    return '"' + "".join("\\" + {v: k for k, v in ESCAPES.items()}[c] if c in ESCAPES.values() else c for c in text) + '"'


def serialize(fields: dict[str, Any]) -> str:
    """A header that `parse` reads back as the same mapping."""
    out: list[str] = []
    for key, value in fields.items():
        if isinstance(value, dict) and value:
            out += [f"{key}:", *(f"  {k}: {written(v)}" for k, v in value.items())]
        elif isinstance(value, (dict, list)) and not value:
            out.append(f"{key}:")
        elif isinstance(value, list) and value:
            out.append(f"{key}:")
            for item in value:
                if isinstance(item, dict):
                    out += [("  - " if i == 0 else "    ") + f"{k}: {written(v)}" for i, (k, v) in enumerate(item.items())]
                else:
                    out.append(f"  - {written(item)}")
        else:
            out.append(f"{key}: {written(value)}")
    return "".join(f"{x}\n" for x in out)


def parsed(text: str | None) -> dict[str, Any]:
    """fields (JSON), body, error and its line in the text (null: parsed).  A header that can't be split off leaves the whole text as body."""
    try:
        header, body = split(text)
    except HeaderError as e:
        return {"fields": None, "body": text, "error": e.reason, "line": e.line + 1}
    if header is None:
        return {"fields": None, "body": body, "error": "no header", "line": 1}
    try:
        return {"fields": json.dumps(parse(header), ensure_ascii=False), "body": body, "error": None, "line": None}
    except HeaderError as e:
        return {"fields": None, "body": body, "error": e.reason, "line": e.line + 1}


@F.pandas_udf(StructType().add("fields", "string").add("body", "string").add("error", "string").add("line", "integer"))
def parsed_column(text: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([parsed(t) for t in text], columns=["fields", "body", "error", "line"])
    return out.astype({"line": "Int32"})
