"""Folders of a collection as tables: listed folder by folder on the executors, and read in parts of like size.

For folders that the driver and the executors see under one path.  Names that
start with an underscore are files like any other; hidden and ignored folders,
files whose real place lies outside the folder that is read, and hidden files
stay out, and links to folders aren't followed.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources.shared import shared_dir

LISTED = "rel_path string, top string, kind string, folder boolean, file_size long, mtime double"
SCHEMA = "rel_path string, content binary, file_size long, mtime double"
#: A part is read by one task: about so many bytes, where a file counts for some by itself.
PART_BYTES, FILE_BYTES = 32_000_000, 16_000
#: What a task holds before it hands files on.
BATCH_BYTES = 8_000_000


def walk(root: str, top: str, suffix: str | None, skip: tuple[str, ...] = ()) -> Iterator[str]:
    """Paths below a top-level folder, relative to the root, in order."""
    from marginalia.functions.scalar import MANIFEST
    from marginalia.sources.vault import excluded

    real = os.path.realpath(os.path.join(root, top))
    for folder, folders, names in os.walk(os.path.join(root, top)):
        inner = os.path.relpath(folder, root).replace(os.sep, "/")
        folders[:] = sorted(f for f in folders if not excluded(f) and f"{inner}/{f}" not in skip)
        for name in sorted(names):
            path = os.path.realpath(os.path.join(folder, name))
            if not name.startswith(".") and (suffix is None or (name.endswith(suffix) and name != MANIFEST)) and (path + os.sep).startswith(real + os.sep) and os.path.isfile(path):
                yield f"{inner}/{name}"


def _inside(root: str, folder: str, top: str, kind: str, skip: Sequence[str]) -> Iterator[tuple]:
    """What one folder holds that belongs to the collection: further folders, and files."""
    from marginalia.functions.scalar import MANIFEST
    from marginalia.sources.vault import excluded

    real = os.path.realpath(os.path.join(root, top)) + os.sep
    try:
        entries = list(os.scandir(os.path.join(root, folder)))
    except (FileNotFoundError, NotADirectoryError):  # gone since it was listed
        return
    for e in entries:
        path = f"{folder}/{e.name}"
        if e.is_dir(follow_symlinks=False):
            if not excluded(e.name) and path not in skip:
                yield path, top, kind, True, 0, 0.0
        elif not e.name.startswith(".") and (kind == "raw" or (e.name.endswith(".md") and e.name != MANIFEST)):
            try:
                if e.is_file() and (not e.is_symlink() or (os.path.realpath(e.path) + os.sep).startswith(real)):
                    stat = e.stat()
                    yield path, top, kind, False, stat.st_size, stat.st_mtime
            except FileNotFoundError:
                continue


def discover(spark: SparkSession, root: str, templates: str = "", suffixes: Sequence[str] | None = None, kinds: Sequence[str] = ("notes", "raw")) -> DataFrame:
    """rel_path, kind (notes or raw), file_size, mtime, settings of all notes and raw files: one row for each path.

    settings says how a file is read: raw files whose suffix is one of `suffixes` as text, others by their names
    alone.  Each round lists the folders that the one before found, in as many tasks as there are; rounds are written
    down, and only whether there is a next one comes to the driver.
    """
    from marginalia.sources.vault import RESERVED, TEXT_SUFFIXES, excluded

    root, skip = root.rstrip("/"), tuple(filter(None, [templates.strip("/")]))
    names = sorted(os.listdir(root)) if os.path.isdir(root) else []
    tops = [(d, d, "raw" if d == "raw" else "notes", True, 0, 0.0) for d in names if os.path.isdir(os.path.join(root, d)) and not excluded(d) and d not in skip and (d == "raw" or d not in RESERVED)]
    where = f"{shared_dir(spark)}/marginalia/listing-{uuid.uuid4().hex}"

    def listed(batches):
        import pandas as pd

        for batch in batches:
            for row in batch.itertuples():
                yield pd.DataFrame(list(_inside(root, row.rel_path, row.top, row.kind, skip)), columns=["rel_path", "top", "kind", "folder", "file_size", "mtime"])

    found = spark.createDataFrame([t for t in tops if t[2] in kinds], LISTED)
    n = 0
    found.write.parquet(f"{where}/round={n}")
    while not found.isEmpty():
        n += 1
        found.repartition("rel_path").mapInPandas(listed, LISTED).write.parquet(f"{where}/round={n}")
        found = spark.read.schema(LISTED).parquet(f"{where}/round={n}").where("folder")
    files = spark.read.schema(LISTED).parquet(*[f"{where}/round={i}" for i in range(n + 1)]).where("NOT folder")
    suffix = F.lower(F.regexp_extract("rel_path", r"[^/.](\.[^./]+)\z", 1))
    text = suffix.isin([x.lower() for x in (TEXT_SUFFIXES if suffixes is None else suffixes)])
    settings = F.when(F.col("kind") == "notes", "note").when(text, "text").otherwise("name")
    return files.select("rel_path", "kind", "file_size", "mtime", settings.alias("settings"))


def read(files: DataFrame, root: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """rel_path, content, file_size, mtime of listed files (rel_path, file_size): dealt out by path in as many parts as their bytes ask for.

    A file that is gone has no row; sizes and times are those at reading.
    """
    weight = files.agg(F.sum(F.col("file_size") + FILE_BYTES)).first()[0] or 0
    names = ["rel_path", "content", "file_size", "mtime"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        stat = os.fstat(f.fileno())
                        held.append((path, f.read(), stat.st_size, stat.st_mtime))
                except FileNotFoundError:
                    continue
                size += len(held[-1][1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], names)

    return files.select("rel_path").repartition(max(1, -(-weight // part_bytes)), "rel_path").mapInArrow(load, SCHEMA)


def collection(spark: SparkSession, root: str, kind: str = "notes", templates: str = "") -> DataFrame:
    """rel_path, content, file_size, mtime of all notes, or of all raw files; an empty folder gives no rows."""
    return read(discover(spark, root, templates, kinds=[kind]), root)
