"""Limits on archives, and the test for scanned files, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_CHARS_PER_PAGE = 12


def is_scanned(chars: Column, pages: Column) -> Column:
    """Too little text per page over the whole file."""
    return (pages > 0) & (chars / pages < LEAST_CHARS_PER_PAGE)


def guarded(members: DataFrame, archive: str, order: str, most: int, most_bytes: int) -> DataFrame:
    """Members with what came before them (count and bytes) and whether they are read.

    The limits are tested before each member, so the last one may exceed them. Members
    of one archive are read in order by one reader; so is the window here.
    """
    before = Window.partitionBy(archive).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    count, size = F.count("*").over(before), F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long")
    return members.withColumns({"members_before": count, "bytes_before": size}).withColumn("read", (F.col("members_before") < most) & (F.col("bytes_before") < most_bytes))
