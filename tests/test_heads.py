"""Queries over what headers say don't read bodies in; hashes of bodies don't depend on how long their blanks are."""

import hashlib
import re
import time

from pyspark.sql import functions as F

from marginalia.functions.scalar import body_hash
from marginalia.functions.text import MIXED
from marginalia.plans import adapters, registry

NARROW = ("lint_unparseable", "lint_enum_invalid", "lint_tag", "lint_alias", "lint_nesting", "path_algebra", "path_violation", "actor_valid", "timestamp_valid", "status_by_layer", "status_by_type", "status_by_status")


def test_header_queries_write_and_read_no_bodies(spark, sf_dir):
    held = dict(adapters._BUILT)
    adapters._BUILT.clear()
    try:
        for name in NARROW:
            rows = registry.QUERIES[name](spark, sf_dir)
            assert not adapters._BUILT, name
            scans = re.findall(r"ReadSchema: (\S+)", rows._jdf.queryExecution().toString())
            assert scans and not any("text:" in s for s in scans), name
    finally:
        adapters._BUILT.update(held)


def plain_hash(text):
    lines = re.sub(r"\r\n?", "\n", text).split("\n")
    blank = "\t\x0b\f\x1c\x1d\x1e\x1f \x85\xa0                　"
    return "sha256:" + hashlib.sha256("\n".join(x.rstrip(blank) for x in lines).strip("\n").encode()).hexdigest()


def test_body_hash_of_blanks(spark):
    texts = ["", "\n", " \n\n", "a \t\nb　 \r\n\r c​ \n", "\r\r\na\r", "\xa0x\xa0\x85\n\n y ", " ", "ü \n\n\n", "no end", " ß　 \n\U0001f600 \n"]
    long = "a" + " " * 300_000 + "b\n"
    rows = spark.createDataFrame([(t,) for t in [*texts, long]], "b string")
    begun = time.time()
    assert [r[0] for r in rows.select(body_hash(F.col("b"))).collect()] == [plain_hash(t) for t in [*texts, long]]
    assert time.time() - begun < 20  # each blank of a run was once tried as its start: 45 thousand million steps
    assert spark.createDataFrame([(None,)], "b string").select(body_hash(F.col("b"))).first()[0] is None


def test_mixed_words(spark):
    words = ["FooBar", "foobar", "FOOBAR", "Foo", "SoA", "fp8", "FP8", "HTTPServer", "x9Y", "A1b", "a1", "iOS", "Ab", "aB", "1aB", "ABc"]
    plain = [w for w in words if re.search("[a-z]", w) and re.search("[A-Z]", w) and re.search("[a-z0-9][A-Z]|[A-Z][A-Z][a-z]|[A-Za-z][0-9]|[0-9][a-z]", w)]
    rows = spark.createDataFrame([(", ".join(words),)], "t string")
    assert rows.select(F.regexp_extract_all("t", F.lit(MIXED), F.lit(0))).first()[0] == plain
