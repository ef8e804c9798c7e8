"""The manifest against a plain recursion over lists, and against its SQL."""

import hashlib

import pytest
from pyspark.sql import functions as F

from marginalia.llm import merkle
from tests.oracle import compare, connect


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: dict) -> str:
    return sha(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FIELDS])


def reduce(nodes: list[str], fanout: int) -> tuple[str, list[list[str]]]:
    """The top, and for each node its siblings' texts by level."""
    paths, places, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, p in zip(paths, places, strict=True):
            first = p - p % fanout
            path.append("".join(level[first:p] + level[p + 1 : first + fanout]))
        level = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        places = [p // fanout for p in places]
    return level[0], paths


def brute(rows: list[dict], fanout: int) -> list[tuple]:
    trees = {}
    for r in rows:
        trees.setdefault("" if r["lang"] is None else "=" + r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    names = sorted(trees, key=str.encode)
    tops = {t: reduce([x[2] for x in sorted(trees[t])], fanout) for t in names}
    root, over = reduce([tops[t][0] for t in names], fanout) if names else ("", [])
    found = []
    for t, rest in zip(names, over, strict=True):
        for place, ((known, i, leaf), path) in enumerate(zip(sorted(trees[t]), tops[t][1], strict=True)):
            found.append((t, i if known else None, place, leaf, tops[t][0], root, sha(*path, *rest)))
    return sorted(found, key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, size int, rank string"


def rows_of(kind: str) -> list[dict]:
    row = lambda i, text="x", lang="en", source="s", n=1: {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": n, "tree": "t", "size": 3, "rank": "r"}
    return {
        "empty": [],
        "one": [row(5)],
        "dense": [row(i, lang=["en", "de", None, "", "é"][i * i % 5]) for i in range(150)],
        "sparse": [row((i * 7919**5) % 2**63 * (-1) ** i) for i in range(90)] + [row(-(2**63)), row(2**63 - 1)],
        "nulls": [row(None, None, None, None, None), row(None, "", "en", "", 0), row(1, None), row(2, "é\U0001f600"), row(3, "y" * 200_000), row(-4)],
        # one id and one row with a third of all rows each
        "hot": [row(7, text=f"t{i}") for i in range(80)] + [row(8)] * 80 + [row(None, n=i % 9) for i in range(40)] + [row(i) for i in range(40)],
    }[kind]


@pytest.mark.parametrize("kind", ["empty", "one", "dense", "sparse", "nulls", "hot"])
@pytest.mark.parametrize("fanout,depth", [(2, 3), (3, 2)])
def test_against_recursion(spark, kind, fanout, depth):
    rows = rows_of(kind)
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    found = merkle.proofs(merkle.leaves(docs), fanout, depth)
    text = F.array_join(F.transform("proof", lambda run: F.concat(run["before"], run["after"])), "")
    shown = found.select("tree", "id", "rank", "leaf", "subroot", "root", F.sha2(text, 256), merkle.fold(F.col("leaf"), F.col("proof")).alias("again")).collect()
    assert sorted((tuple(r)[:-1] for r in shown), key=str) == brute(rows, fanout)
    assert all(r.again == r.root for r in shown)


def test_a_changed_leaf_or_path_fails(spark):
    docs = spark.createDataFrame([tuple(r.values()) for r in rows_of("dense")], SCHEMA)
    found = merkle.proofs(merkle.leaves(docs))
    other = F.sha2("leaf", 256)
    shorter = F.slice("proof", 2, 1000)
    assert found.where((merkle.fold(other, F.col("proof")) == F.col("root")) | (merkle.fold(F.col("leaf"), shorter) == F.col("root"))).count() == 0


def test_query(spark, sf_dir):
    assert compare(spark, "op11", merkle.op11, merkle.SQL, connect(sf_dir), sf_dir) == ""
    got = merkle.op11(spark, sf_dir).groupBy("verified").count().collect()
    assert {r.verified for r in got} == {True, False}
