"""Mixing sources to target weights, with DataFrame operations only.

Tokens are summed per source; the target of each source is its share of all
tokens by weight, held at ``most`` times what the source has, with the excess
shared again by weight until no source is above its bound. The repetition rate
of a source is its target over its size. Each document is emitted floor(rate)
times, plus once more with the probability rate - floor(rate).

The further copies are drawn systematically, so that a source's words come to its
target up to about its largest document: a source's documents stand in the order
of their size class, each class in cells by a hash of id and text; running sums of
the fraction over the cells, begun at a hash-seeded place, say how many documents of
a cell get a copy, and those with the least hashes get it. Every document has the
same probability, and reruns agree. Cells number sources times classes plus one for
each ``CELL`` documents; documents themselves are never shuffled, only their hashes.

Defined cases: a null text has size 0 and keeps its copies; a null source is a
source of its own and comes last; rows that repeat id and text draw the same number;
when all sizes are 0, every rate is 0; an empty table gives an empty result; ``mix``
returns the input's columns whatever their names, while in ``plan_copies`` the plan's
columns (which begin with an underscore) replace any of the same names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged, unstage, word_count

#: Size classes per doubling of the size; hashes that a cell holds on average at most.
CLASSES, CELL = 16, 1 << 20
#: Up to so many cells, their table (five numbers and a name each) is broadcast; beyond, it is joined by shuffle.
BROADCAST_CELLS = 200_000


def cycling_weights(source_rank: Column) -> Column:
    """1, 2, 3, 1, ... by the rank of the source."""
    return ((source_rank - 1) % 3 + 1).cast("double")


def source_targets(sizes: DataFrame, weight: Callable[[Column], Column] = cycling_weights, most: float = 3.0) -> DataFrame:
    """Per ``_source``: ``_source_size`` (tokens), ``_target`` and ``_rate``.

    Sharing the excess again and again ends where one level L gives every source
    min(bound, L * weight) and all targets add up to the total. Ordered by bound
    over weight, the sources at their bound are those where the level that would
    be left for the rest is above their own ratio; running sums find it in one go.
    The windows here are over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    ratio = Window.orderBy("_ratio", F.col("_source").asc_nulls_last())
    all_of = Window.partitionBy()
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    per = per.withColumn("_weight", weight(F.row_number().over(by_name)))
    per = per.withColumn("_bound", F.lit(most) * F.col("_source_size")).withColumn("_ratio", F.col("_bound") / F.col("_weight"))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("_total", F.sum("_source_size").over(all_of)).withColumn(
        "_level", (F.col("_total") - F.coalesce(F.sum("_bound").over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    )
    per = per.withColumn("_full", F.col("_level") > F.col("_ratio"))
    # the level of the first source below its bound is the level of them all
    level = F.min(F.when(~F.col("_full"), F.struct("_ratio", "_level"))).over(all_of)["_level"]
    per = per.withColumn("_target", F.when(F.col("_full"), F.col("_bound")).otherwise(F.least(F.col("_bound"), level * F.col("_weight"))))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    return per.select("_source", "_source_size", F.col("_target").cast("double").alias("_target"), rate.alias("_rate"))


def unit_draw(*of: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the values and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _marked(docs: DataFrame, seed: str) -> DataFrame:
    """``docs`` with ``_size``, ``_class`` and ``_h``, the hash by which a cell's documents are ordered."""
    sized = docs.withColumn("_size", word_count(F.col("text")))
    return sized.withColumn("_class", F.coalesce(F.floor(F.log2(F.col("_size") + 1.0) * CLASSES).cast("int"), F.lit(0))).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text"))


def drawn_cells(narrow: DataFrame, weight: Callable[[Column], Column], most: float, seed: str) -> DataFrame:
    """Per cell (``_of``, ``_in``, ``_cells``, ``_cell``) its source's numbers and ``_last``, the greatest hash that gets a further copy.

    ``narrow``: a staged table of _source, _size, _class, _h. The windows here are
    over one row per cell, never over documents.
    """
    classes = staged(narrow.groupBy("_source", "_class").agg(F.sum("_size").alias("_size"), F.count("*").alias("_n")), "classes")
    per = source_targets(classes, weight, most)
    cells = classes.select("_source", "_class", F.ceil(F.col("_n") / CELL).cast("int").alias("_cells"))
    cells = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    same = lambda a, b: a["_source"].eqNullSafe(b["_source"]) & (a["_class"] == b["_class"])
    dealt = narrow.join(cells, same(narrow, cells)).select(narrow["_source"], narrow["_class"], "_cells", F.pmod("_h", "_cells").alias("_cell"), "_h")
    filled = dealt.groupBy("_source", "_class", "_cells", "_cell").agg(F.sort_array(F.collect_list("_h")).alias("_hashes"))
    filled = filled.withColumn("_n", F.size("_hashes"))
    before = Window.partitionBy("_source").orderBy("_class", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = filled.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = placed.join(per.withColumnRenamed("_source", "_name"), F.col("_source").eqNullSafe(F.col("_name")))
    part, start = F.col("_rate") - F.floor("_rate"), unit_draw(F.col("_source"), seed=seed)
    take = F.floor((F.col("_before") + F.col("_n")) * part + start) - F.floor(F.col("_before") * part + start)
    last = F.when(take > 0, F.element_at("_hashes", F.least(take, F.col("_n")).cast("int")))
    return placed.select(F.col("_source").alias("_of"), F.col("_class").alias("_in"), "_cells", "_cell", "_source_size", "_target", "_rate", last.alias("_last"))


def _copied(marked: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds ``_source_size``, ``_target`` and ``_copies`` to rows of _source, _size, _class and _h."""
    cells = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    own = F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_class") == F.col("_in")) & (F.pmod("_h", "_cells") == F.col("_cell"))
    copies = F.floor("_rate") + F.coalesce(F.col("_h") <= F.col("_last"), F.lit(False)).cast("int")
    return marked.join(cells, own).withColumn("_copies", copies.cast("int")).drop("_of", "_in", "_cells", "_cell", "_rate", "_last", "_class", "_h")


def plan_copies(docs: DataFrame, weight: Callable[[Column], Column] = cycling_weights, most: float = 3.0, seed: str = "mix") -> DataFrame:
    """``docs`` with ``_size``, ``_source_size``, ``_target`` and ``_copies`` (how often the mix takes the document)."""
    marked = _marked(docs, seed).withColumn("_source", F.col("source"))
    narrow = staged(marked.select("_source", "_size", "_class", "_h"), "marked")
    cells = staged(drawn_cells(narrow, weight, most, seed), "cells")
    unstage(narrow)
    return _copied(marked, cells).drop("_source")


def mix(docs: DataFrame, weight: Callable[[Column], Column] = cycling_weights, most: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mixed corpus: each document as often as ``plan_copies`` says, with the columns of ``docs``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    planned = plan_copies(docs.select(whole, "doc_id", "text", "source"), weight, most, seed).where("_copies > 0")
    return planned.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are read once: what the plan needs of each document is staged, and the result is made from that."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("_source"))
    marked = staged(_marked(docs, "mix").drop("text"), "marked")
    cells = staged(drawn_cells(marked, cycling_weights, 3.0, "mix"), "cells")
    return _copied(marked, cells).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).cast("long").alias("taken"), F.col("_copies").alias("copies"),
    )
