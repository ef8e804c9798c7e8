"""The least few values of each group, and how many there are: partial results stay small wherever rows are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def least(rows: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The columns `by`, first (the k least distinct values, in order) and total (how many distinct values there are).

    Values are made distinct before anything else, and every task keeps k of a group
    before the shuffle, so a group with most of the rows costs no task more than k rows of each other.
    Null values aren't counted; a group with no others has no row.  Null groups are a group.
    """
    each = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_value")).distinct()
    place = F.row_number().over(W.partitionBy(*by).orderBy("_value"))
    first = each.withColumn("_place", place).where(F.col("_place") <= k).groupBy(*by).agg(F.sort_array(F.collect_list("_value")).alias("first"))
    total = each.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.count("*").alias("total"))
    return first.join(total, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])).drop(*[f"_{c}" for c in by])
