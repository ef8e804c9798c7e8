"""Provenance: human attestations against the commits that wrote their lines.

`entries` finds every human attestation and the lines it stands on; `blame` says
which commit and author wrote each line.  The audit is their join.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from marginalia.functions import frontmatter

UNCOMMITTED = "0" * 40
#: Signatures that hold.
SIGNED = ("G", "U")
_BY = re.compile(r"\s*(?:-\s*)?by\s*:\s*[\"']?(human:[^\"'\s#]+)")


def human_entries(text: str | None) -> Iterator[tuple[str, int, list[int]]]:
    """(actor, line that names it, all its lines) of each human entry under `verified`; lines count from 1 in the file."""
    header, _ = frontmatter.split(text)
    inside, item = False, []
    for n, line in [*enumerate((header or "").split("\n"), 2), (0, "end:")]:
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        top = not line.startswith(" ")
        if item and (top or line.lstrip().startswith("-")):
            named = [(m[1], k) for k, x in item if (m := _BY.match(x))]
            if named:
                yield *named[-1], [k for k, _ in item]
            item = []
        if top:
            inside = re.match(r"verified\s*:", line) is not None
        elif inside and (item or line.lstrip().startswith("-")):
            item.append((n, line))


@F.pandas_udf(ArrayType(StructType().add("actor", "string").add("by_line", "integer").add("line", "integer")))
def entry_lines(text: pd.Series) -> pd.Series:
    """A row for each line of each human entry, the one that names the actor first; a header that can't be read has one without an actor."""

    def each(t: str | None) -> list[dict]:
        try:
            return [{"actor": actor, "by_line": by, "line": n} for actor, by, lines in human_entries(t) for n in [by, *(x for x in lines if x != by)]]
        except frontmatter.HeaderError as e:
            return [{"actor": None, "by_line": e.line + 1, "line": e.line + 1}] if "human:" in (t or "") else []

    return text.map(each)


def entries(files: DataFrame) -> DataFrame:
    """rel_path, actor, by_line, line, pos of files (rel_path, text)."""
    return files.select("rel_path", F.posexplode(entry_lines("text")).alias("pos", "e")).select("rel_path", "pos", "e.actor", "e.by_line", "e.line")


def audit(entries: DataFrame, blame: DataFrame, identities: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """code, rel_path, line, actor, commit, message: the first fault of each entry.

    blame: rel_path, line, commit, email, a row for each committed or uncommitted
    line; identities: actor, email; signatures: commit, status, to require that
    commits are signed.  An entry whose lines nobody is blamed for has no history.
    """
    known = identities.select("actor", "email", F.lit(True).alias("known")).distinct()
    rows = entries.join(blame, ["rel_path", "line"], "left").join(known, ["actor", "email"], "left")
    where = F.when(F.col("line") == F.col("by_line"), "attestation").otherwise(F.concat(F.lit("attestation (its line "), F.col("line").cast("string"), F.lit(")")))

    def fault(*text: Column | str) -> Column:
        return F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text])

    who = F.concat(F.lit("'"), "actor", F.lit("' "))
    message = (
        F.when(F.col("actor").isNull(), fault("the header can't be read, so its human attestations can't be audited"))
        .when(F.col("commit").isNull(), fault(who, where, " has no history; commit the file"))
        .when(F.col("commit") == UNCOMMITTED, fault(who, where, " isn't committed yet"))
        .when(F.col("known").isNull(), fault("author '", F.coalesce("email", F.lit("")), "' of the ", who, where, " isn't one of the actor's identities"))
    )
    found = rows.withColumn("message", message).withColumn("code", F.lit("PROVENANCE_MISMATCH"))
    if signatures is not None:
        found = found.join(signatures.select("commit", "status").distinct(), "commit", "left")
        bad = F.col("message").isNull() & ~F.coalesce(F.col("status").isin(*SIGNED), F.lit(False))
        unsigned = F.struct(F.lit("UNSIGNED_ENDORSEMENT").alias("code"), fault("commit ", F.substring("commit", 1, 8), " of the ", who, "attestation isn't signed").alias("message"))
        found = found.withColumn("u", F.when(bad, unsigned)).withColumn("code", F.coalesce("u.code", "code")).withColumn("message", F.coalesce("message", "u.message"))
    first = F.min(F.struct(F.col("code") == "UNSIGNED_ENDORSEMENT", "pos", "code", F.when(F.col("code") == "UNSIGNED_ENDORSEMENT", F.col("by_line")).otherwise(F.col("line")).alias("line"), F.coalesce("commit", F.lit("")).alias("commit"), "message"))
    faults = found.where("message IS NOT NULL").groupBy("rel_path", "by_line", F.coalesce("actor", F.lit("")).alias("actor")).agg(first.alias("f"))
    return faults.select("f.code", "rel_path", "f.line", "actor", "f.commit", "f.message")


def blame(spark: SparkSession, root: str, entries: DataFrame, timeout: int = 30) -> DataFrame:
    """What git says of the files that hold entries (few: those with human attestations), asked on the driver."""
    rows: list[tuple[str, int, str, str]] = []
    for (path,) in entries.select("rel_path").distinct().collect():
        said = subprocess.run(["git", "blame", "--line-porcelain", "--", path], cwd=root, capture_output=True, text=True, timeout=timeout, check=False)
        commit, line, email = "", 0, ""
        for x in said.stdout.split("\n") if said.returncode == 0 else []:
            if m := re.match(r"([0-9a-f]{40}) \d+ (\d+)", x):
                commit, line = m[1], int(m[2])
            elif x.startswith("author-mail "):
                email = x.removeprefix("author-mail ").strip("<>")
            elif x.startswith("\t"):
                rows.append((path, line, commit, email))
    return spark.createDataFrame(rows, "rel_path string, line int, commit string, email string")
