"""Change detection between a listing of files and a snapshot: one full outer join, then work on what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-4


def classify(snapshot: DataFrame, listing: DataFrame, by_hash: bool = False) -> DataFrame:
    """rel_path, change (insert, update, delete, same) of frames (rel_path, mtime, file_size[, file_hash]).

    Where both say under which `settings` a file is read, other settings make an update of an unchanged file.
    """
    settings = ["settings"] if "settings" in snapshot.columns and "settings" in listing.columns else []
    columns = ["mtime", "file_size", *(["file_hash"] if by_hash else []), *settings]
    old = snapshot.select("rel_path", F.lit(True).alias("_old"), *[F.col(c).alias(f"_{c}") for c in columns])
    new = listing.select("rel_path", F.lit(True).alias("_new"), *columns)
    same = F.col("file_hash").eqNullSafe(F.col("_file_hash")) if by_hash else (F.abs(F.col("mtime") - F.col("_mtime")) <= TOLERANCE) & (F.col("file_size") == F.col("_file_size"))
    if settings:
        same &= F.col("settings").eqNullSafe(F.col("_settings"))
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.coalesce(same, F.lit(False)), "same").otherwise("update")
    return old.join(new, "rel_path", "full_outer").select("rel_path", change.alias("change"))


def pending(snapshot: DataFrame, listing: DataFrame) -> DataFrame:
    """change, n: what a scan would do, without reading a file; no rows but `same` means that it would do nothing."""
    return classify(snapshot, listing).groupBy("change").agg(F.count("*").alias("n"))


def apply(snapshot: DataFrame, parsed: DataFrame, changes: DataFrame) -> DataFrame:
    """The next snapshot: unchanged rows as they are, and freshly parsed rows for what was inserted or updated."""
    kept = snapshot.join(changes.where("change = 'same'").select("rel_path"), "rel_path", "left_semi")
    fresh = parsed.join(changes.where("change in ('insert', 'update')").select("rel_path"), "rel_path", "left_semi")
    return kept.unionByName(fresh, allowMissingColumns=True)
