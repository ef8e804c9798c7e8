"""A search index and link table that follow a collection: each scan reads what changed, and commits the next version.

A version's tables are lists of segments, each with the rows of the notes that one scan read:
`notes`, `lengths`, `postings`, `terms` and `edges`.  Segments never change.  `files`, a narrow row
for each file, says which segment holds its current rows; rows of other segments are
out of date, so deleting a note or replacing it touches no segment.  `targets` has what each name that
a link asks for means; only names that a changed note answers to are looked up again.
The number of notes and of their words are sums that each scan moves on.

When there are many segments, the younger ones are merged until every
segment is more than twice as large as the next, so a note is rewritten a logarithmic number of times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import delta, resolve, search
from marginalia.sources import notes as ingest
from marginalia.sources.snapshots import Snapshots, Version

#: More segments than this are merged.
SEGMENTS = 8
_SEGMENTED = ("notes", "lengths", "postings", "edges")
_FILE = ("rel_path", "mtime", "file_size", "settings")

Read = Callable[[DataFrame], DataFrame]


def _listed(listing: DataFrame) -> DataFrame:
    settings = F.col("settings") if "settings" in listing.columns else F.lit("")
    return listing.select("rel_path", "mtime", "file_size", settings.alias("settings"))


def _folder(written: tuple[str, str]) -> tuple[str, tuple[str]]:
    return written[0], (written[1],)


def pending(store: Snapshots, listing: DataFrame) -> bool:
    """Whether a scan of this listing (rel_path, mtime, file_size[, settings]) would change anything.  No file is read."""
    base = store.latest()
    if base is None:
        return True
    return not delta.classify(store.read(base, "files").select(*_FILE), _listed(listing)).where("change != 'same'").isEmpty()


def scan(store: Snapshots, listing: DataFrame, read: Read, links: Read = ingest.note_links) -> Version:
    """Brings the store up to a listing, and gives the version that is then the latest.

    listing: rel_path, mtime, file_size and, where files of one kind are read differently in time, `settings`, a
    fingerprint of how.  read: from paths (rel_path) to their notes (rel_path, cid, layer, parse_error and the
    columns of the index).  links: from notes to their links (source_cid, kind, target).  Only inserted and
    updated paths are read.  Without a usable version everything is.
    """

    def step(base: Version | None, number: int) -> Version | None:
        spark = store.spark
        seen = store.read(base, "files") if base else spark.createDataFrame([], "rel_path string, mtime double, file_size long, settings string, cid string, corpus string, fine boolean, segment long")
        listed = _listed(listing)
        made = {}

        def kept(rows: DataFrame, table: str) -> DataFrame:
            schema, folder = made[table] = store.write(rows, table)
            return store.load(schema, (folder,))

        changes = kept(delta.classify(seen.select(*_FILE), listed).where("change != 'same'"), "changes")
        if base and changes.isEmpty():
            return None
        here = lambda df: df.withColumn("segment", F.lit(number).cast("long"))
        fresh = kept(here(read(changes.where("change IN ('insert', 'update')").select("rel_path"))), "notes")
        held = store.load(*_folder(store.write(search.blocks(fresh), "blocks")))  # texts are read once; no version names this
        lengths = kept(search.lengths_of(held), "lengths")
        kept(search.sorted_postings(held), "postings")
        words = search.terms_of(held)
        if base:
            words = words.join(store.read(base, "terms").select("term"), "term", "left_anti")
        kept(search.dictionary(words), "terms")
        new_edges = kept(here(resolve.probes(links(fresh))), "edges")

        gone = seen.join(changes.select("rel_path"), "rel_path", "left_semi")
        now = fresh.select("rel_path", "cid", search._corpus().alias("corpus"), F.col("parse_error").isNull().alias("fine"), "segment").join(listed, "rel_path").select(*_FILE, "cid", "corpus", "fine", "segment")
        files = kept(seen.join(changes.select("rel_path"), "rel_path", "left_anti").unionByName(now), "files")

        changed = gone.select("cid").unionByName(now.select("cid"))
        asked = new_edges.where("by IS NOT NULL").select("by", "name")
        notes = files.where("corpus = 'notes'")
        names, broken = notes.select("cid"), notes.where("NOT fine").select("cid")
        if base:
            before = store.read(base, "targets")
            kept(resolve.lookup_again(before, asked.unionByName(before.select("by", "name")).distinct(), changed, names, broken), "targets")
        else:
            kept(resolve.lookup(asked.distinct(), names, broken), "targets")

        sums = {c: tuple(x) for c, x in base.facts["sums"].items()} if base else {}
        for sign, rows in ((1, lengths), (-1, _current(store.read(base, "lengths"), gone) if base else None)):
            for r in rows.groupBy("corpus").agg(F.count("*").alias("n"), F.sum("dl").alias("d")).collect() if rows else []:  # a row for each corpus
                n, d = sums.get(r.corpus, (0, 0))
                sums[r.corpus] = (n + sign * r.n, d + sign * r.d)
        segments = (base.facts["segments"] if base else []) + [[number, fresh.count()]]
        tables = {t: (schema, (*(base.folders(t) if base and t in (*_SEGMENTED, "terms") else ()), folder)) for t, (schema, folder) in made.items()}
        return Version(number, tables, {"sums": sums, "segments": segments})

    version = store.update(step)
    return merge(store) if len(version.facts["segments"]) > SEGMENTS else version


def _current(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The rows (cid, segment) that are those of files' current segments."""
    return rows.join(files.select("cid", "segment"), ["cid", "segment"], "left_semi")


def _edges_of(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select(F.col("cid").alias("source_cid"), "segment"), ["source_cid", "segment"], "left_semi")


def merge(store: Snapshots, every: bool = False) -> Version:
    """Writes the younger segments as one, until each is more than twice as large as the next; `every`: all of them.

    The same rows answer as before.  Rows that are out of date are left behind.
    """

    def step(base: Version | None, number: int) -> Version | None:
        segments = base.facts["segments"] if base else []
        n = len(segments) - 1
        total = segments[n][1] if segments else 0
        while n > 0 and (every or segments[n - 1][1] <= 2 * total):
            n -= 1
            total += segments[n][1]
        if n >= len(segments) - 1:
            return None
        old = [s for s, _ in segments[n:]]
        files, tables = store.read(base, "files"), dict(base.tables)
        for t in _SEGMENTED:
            schema, folders = tables[t]
            young = store.load(schema, folders[n:])
            rows = (_edges_of if t == "edges" else _current)(young, files).withColumn("segment", F.lit(number).cast("long"))
            if t == "postings":
                rows = search.in_order(rows)
            tables[t] = (schema, (*folders[:n], store.write(rows.select(*young.columns), t)[1]))
        moved = files.withColumn("segment", F.when(F.col("segment").isin(old), F.lit(number).cast("long")).otherwise(F.col("segment")))
        tables["files"] = (tables["files"][0], (store.write(moved, "files")[1],))
        tables["terms"] = (tables["terms"][0], (store.write(store.read(base, "terms").distinct(), "terms")[1],))
        size = files.where(F.col("segment").isin(old)).count()
        return Version(number, tables, base.facts | {"segments": [*segments[:n], [number, size]]})

    return store.update(step)


def index(store: Snapshots, version: Version) -> search.Index:
    """The version's search index: postings, lengths and notes of current segments."""
    files = store.read(version, "files")
    current = lambda t: _current(store.read(version, t), files).drop("segment")
    return search.Index(store.read(version, "terms"), current("postings"), current("lengths"), current("notes"), {c: tuple(x) for c, x in version.facts["sums"].items()})


def integrity(store: Snapshots, version: Version) -> DataFrame:
    """`search.integrity` of the version, with all segments held against their notes and only current rows counted."""
    files = store.read(version, "files").where("fine")
    whole = search.Index(store.read(version, "terms"), store.read(version, "postings"), store.read(version, "lengths"), store.read(version, "notes"))
    return search.integrity(whole, files)


def links(store: Snapshots, version: Version) -> DataFrame:
    """The version's links with target_cid."""
    rows = _edges_of(store.read(version, "edges"), store.read(version, "files"))
    targets = store.read(version, "targets").withColumnRenamed("cid", "target_cid")
    return rows.join(targets, ["by", "name"], "left").drop("by", "name", "segment")
