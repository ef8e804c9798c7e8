"""Token counts that follow edits.

A document is a balanced tree of segments, each a run of pre-tokens that ends
with white space, with sums of characters and tokens in every subtree.  The
tokenizer's pre-tokens never hold white space, so a segment's tokens don't
depend on its neighbours.  An edit splits out the segments it touches, with the
one before and after as context, encodes those alone again, and merges: sums
are updated on the paths that changed.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import WordTokenizer, slices, table, tokenizer_of, vocab_json

#: A segment is cut at the first white space after so many characters.
SEGMENT = 400
_CUT = re.compile(r"\s(?=\S)")


def segments(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + SEGMENT)
        end = m.end() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


@dataclass(slots=True)
class Node:
    """A treap: by place in the text, heap by `rank`."""

    text: str
    own: int
    rank: float
    left: Node | None = None
    right: Node | None = None
    chars: int = 0
    tokens: int = 0

    def sum(self) -> Node:
        a, b = self.left, self.right
        self.chars = len(self.text) + (a.chars if a else 0) + (b.chars if b else 0)
        self.tokens = self.own + (a.tokens if a else 0) + (b.tokens if b else 0)
        return self


def _merge(a: Node | None, b: Node | None) -> Node | None:
    if not a or not b:
        return a or b
    if a.rank > b.rank:
        a.right = _merge(a.right, b)
        return a.sum()
    b.left = _merge(a, b.left)
    return b.sum()


def _split(n: Node | None, chars: int) -> tuple[Node | None, Node | None]:
    """The segments that end at or before `chars`, and the others."""
    if not n:
        return None, None
    before = (n.left.chars if n.left else 0) + len(n.text)
    if before <= chars:
        n.right, rest = _split(n.right, chars - before)
        return n.sum(), rest
    first, n.left = _split(n.left, chars)
    return first, n.sum()


def _walk(n: Node | None) -> Iterator[Node]:
    stack = []
    while n or stack:
        while n:
            stack.append(n)
            n = n.left
        n = stack.pop()
        yield n
        n = n.right


class Counted:
    """A text whose token count is kept while it is edited."""

    def __init__(self, text: str, tokens: WordTokenizer, counts: list[int] | None = None, parts: list[str] | None = None):
        """counts, parts: of the text's segments, where they are known."""
        self.tokens_of, self.rng, self.encoded = tokens, random.Random(len(text)), 0
        self.root = self._tree(segments(text) if parts is None else parts, counts)

    def _tree(self, parts: list[str], counts: list[int] | None = None) -> Node | None:
        counts = self.tokens_of.counts(parts) if counts is None else counts
        nodes = [Node(p, c, self.rng.random()) for p, c in zip(parts, counts, strict=True)]
        # built bottom up in one pass over the right spine
        spine: list[Node] = []
        for n in nodes:
            last = None
            while spine and spine[-1].rank < n.rank:
                last = spine.pop().sum()
            n.left = last
            if spine:
                spine[-1].right = n
            spine.append(n)
        root = spine[0] if spine else None
        while spine:
            spine.pop().sum()
        return root

    @property
    def n_tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def n_chars(self) -> int:
        return self.root.chars if self.root else 0

    @property
    def text(self) -> str:
        return "".join(n.text for n in _walk(self.root))

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts `new` in place of the characters from start to end (clamped to the text)."""
        edit_all([self], [(start, end, new)], self.tokens_of)

    def _cut(self, start: int, end: int, new: str) -> tuple[Node | None, list[str], Node | None]:
        """(what stays before an edit, the segments that it leaves in between, what stays after); `_join` puts them together."""
        start = min(max(0, start), self.n_chars)
        end = min(max(start, end), self.n_chars)
        # context: the segment that ends where the edit starts, and the one that starts where it ends
        left, rest = _split(self.root, max(0, start - 1))
        shift = left.chars if left else 0
        middle, right = _split(rest, end - shift)
        if right:  # the segment in which the edit ends or that follows it
            first = right
            while first.left:
                first = first.left
            head, right = _split(right, len(first.text))
            middle = _merge(middle, head)
        old = "".join(n.text for n in _walk(middle))
        text = old[: start - shift] + new + old[end - shift :]
        self.encoded += len(text)
        return left, segments(text), right

    def _join(self, left: Node | None, parts: list[str], counts: list[int], right: Node | None) -> None:
        self.root = _merge(_merge(left, self._tree(parts, counts)), right)


def edit_all(docs: list[Counted], edits: list[tuple[int, int, str]], tokens: WordTokenizer) -> None:
    """One edit to each text; the segments that they touch are counted together."""
    cuts = [doc._cut(*edit) for doc, edit in zip(docs, edits, strict=True)]
    counts = iter(tokens.counts([s for _, parts, _ in cuts for s in parts]))
    for doc, (left, parts, right) in zip(docs, cuts, strict=True):
        doc._join(left, parts, [next(counts) for _ in parts], right)


def revisions(n: int) -> list[tuple[int, int, str]]:
    """The edits that op8 applies to a text of n characters, each to the outcome of those before.

    A replacement at a third, a deletion at the middle, an insertion at two
    thirds, and an addition at the end.
    """
    third, half = n // 3, n // 2
    return [(third, min(n, third + 5), "revised wording"), (half, half + 17, ""), (2 * n // 3, 2 * n // 3, " inserted, here "), (1 << 60, 1 << 60, " The end.")]


def recount(docs: DataFrame, edits=revisions, vocab: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_tokens_after, n_chars_after, n_chars_encoded for every row.

    n_tokens counts the text's tokens without an end id; n_tokens_after those
    after edits(length), and n_chars_encoded what had to be encoded again for
    them.  Null texts count as empty, a null doc_id stays null, and repeated rows
    each give a row.  An empty table gives no rows.  Only doc_id and text are
    read, so other columns may have any name.
    """
    spec = docs.sparkSession.sparkContext.broadcast(vocab_json(vocab))
    names = ["doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "n_chars_encoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer_of(spec.value)
        for batch in slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            parts = [segments(t) for t in texts]
            counts = iter(tokens.counts([s for p in parts for s in p]))
            held = [Counted(text, tokens, [next(counts) for _ in p], p) for p, text in zip(parts, texts, strict=True)]
            before = [doc.n_tokens for doc in held]
            to_do = [edits(len(text)) for text in texts]
            for k in range(max(map(len, to_do))):
                some = [i for i, own in enumerate(to_do) if k < len(own)]
                edit_all([held[i] for i in some], [to_do[i][k] for i in some], tokens)
            rows = [(n, doc.n_tokens, doc.n_chars, doc.encoded) for n, doc in zip(before, held, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, edited as `revisions` says.  See `recount` for nulls, repeated rows and empty tables."""
    return recount(table(spark, sf_dir, "documents"))
