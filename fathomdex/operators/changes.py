"""What changed since the last run, and changes applied to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(files: DataFrame, registry: DataFrame) -> DataFrame:
    """The files, and paths that are only registered, with ``change``: new, modified, same or gone.

    A file is the same when its size and its time are as registered. Both sides are
    joined on their metadata before any content is read.
    """
    known = registry.select(F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"))
    both = files.join(known, F.col("path") == F.col("_path"), "full")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime_ns").eqNullSafe(F.col("_mtime"))
    change = F.when(F.col("path").isNull(), "gone").when(F.col("_path").isNull(), "new").when(same, "same").otherwise("modified")
    return both.withColumn("change", change).withColumn("path", F.coalesce("path", "_path")).drop("_path", "_size", "_mtime")


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """All rows of the table's keys that occur in ``rows`` are replaced by those."""
    return delete(table, rows, key).unionByName(rows.select(*table.columns))


def _last(*order: str) -> Column:
    return F.max_by("kind", F.struct(*order))


def coalesced(events: DataFrame) -> DataFrame:
    """One row per path: the kind of its last event by (ts, seq), and how many there were."""
    return events.groupBy("path").agg(_last("ts", "seq").alias("kind"), F.count("*").alias("events"))


def debounced(events: DataFrame, gap: str) -> DataFrame:
    """Events of a path that follow each other within the gap are one change: the last kind counts."""
    rows = events.groupBy(F.session_window("ts", gap).alias("s"), "path").agg(_last("ts", "seq").alias("kind"), F.count("*").alias("events"))
    return rows.select("path", F.col("s.start").alias("since"), "kind", "events")
