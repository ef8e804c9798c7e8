"""Connected components on the cluster by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import materialize


def connected(edges: DataFrame) -> DataFrame:
    """(fp, root) for each end of `edges` (a, b): the smallest member of its component.

    Each round links every node to the smallest of its neighbours (large star:
    the larger neighbours; small star: itself and the smaller ones) until
    nothing changes; rounds grow with the logarithm of a component's size.  Each
    round is a table in the shared folder.  Only the number of changes comes to
    the driver.  Rows with a null end, and links of a node to itself, are left
    out; without links there are no rows.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def stars(links: DataFrame, large: bool) -> DataFrame:
        if large:
            links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        both = links.join(low, "u")
        moved = both.where("v > u" if large else "v != m").select(F.col("v").alias("u"), "m")
        out = moved if large else moved.unionByName(low)
        return out.where("u != m").select("u", F.col("m").alias("v")).distinct()

    while True:
        after = materialize(stars(stars(now, True), False), "links")
        # a fixed point: every node has one link, to a root
        differs = after.join(now, ["u", "v"], "left_anti").isEmpty() and now.join(after, ["u", "v"], "left_anti").isEmpty()
        now = after
        if differs:
            break
    rooted = now.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return rooted.unionByName(now.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
