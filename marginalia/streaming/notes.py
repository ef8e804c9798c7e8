"""New files as a stream: each micro-batch of notes is parsed and appended, and the table is read as of each note's last version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.functions import scalar
from marginalia.sources.notes import notes

_FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, root: str, per_batch: int = 10_000) -> DataFrame:
    """A stream of rel_path, text, file_size, mtime of the notes below `root` as their files appear; at most `per_batch` files a batch.

    The file source notices new files by path.  Hidden and ignored folders and
    what can't be a note stay out, by the same rule as in a walk.
    """
    rows = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", per_batch).load(root)
    rel = F.substring_index("path", root.rstrip("/").removeprefix("file:") + "/", -1)
    found = rows.select(rel.alias("rel_path"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("file_size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))
    return found.where(scalar.path_violation(F.col("rel_path")).isNull())


def ingest(stream: DataFrame, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends each batch's parsed notes to a table of Parquet files; `once` takes what is there and ends.

    A batch that is done again after a failure is written by its number, so it
    counts once: `current` reads the versions, of which equal ones are one.
    """

    def add(batch: DataFrame, number: int) -> None:
        notes(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """Each note's last version: by modification time, then by batch."""
    rows = spark.read.option("mergeSchema", "true").parquet(table)
    last = F.max_by(F.struct(*[c for c in rows.columns if c != "rel_path"]), F.struct("mtime", "batch")).alias("v")  # a partial aggregate
    return rows.groupBy("rel_path").agg(last).select("rel_path", "v.*")
