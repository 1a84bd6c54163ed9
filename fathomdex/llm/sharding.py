"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

The items that are packed are groups of equal texts. Each goes to the shard where the dot
product of its demand with the residual capacity is highest, the largest first. Groups
that are large beside a shard come first of all and are placed on the driver, of which there
can't be more than 3 * shards / ``LARGEST``; one that is too large for any shard is cut into
pieces by a hash of its documents' ids. Placing is sequential by nature, so all other groups are dealt
to blocks of about ``BLOCK`` by hash; a block is packed by one task into its part of the capacity
that the large groups left in each shard. At any size it is the groups that are placed, and a
block ends uneven by no more than its smallest groups.

Rows find their shard by a join on their group, in which groups of more than ``SALT``
rows or ``SALT_BYTES`` are dealt to several tasks by a hash of their ids (rows that repeat id
and text stay in one). The first slot of each part of a group comes from running sums over
the counts of those parts; its rows are numbered from there in the order of their ids, in the
task of the join. So rows are moved once and never written on the way, and no shard or group is ever in one place.

Defined cases: a null text has no bytes and no tokens and the CRC of the empty
string; equal rows may take each other's slots; an empty table gives an empty
result; with fewer groups than shards some shards stay empty; the columns of the
input pass through, and those of the result win where names clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged, unstage, word_count
from .graph import small

#: As parts of a shard, the largest group that is placed in a block and the largest that isn't cut
#: (a larger one is cut into pieces of the size that is placed in blocks). Groups of a block; rows and bytes of a group in one task.
LARGEST, CUT, BLOCK, SALT, SALT_BYTES = 1 / 16, 1 / 2, 50_000, 100_000, 128 << 20
DIMENSIONS = ("bytes", "tokens", "rows")
#: What each dimension counts in the dot product; the law that the shards promise is on bytes.
WEIGHTS = (1.0, 0.25, 0.25)


def measured(docs: DataFrame, overhead: int = 16) -> DataFrame:
    """Adds _size (UTF-8 bytes and overhead), _tokens, _crc and _group (a hash of the text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.withColumn("_size", (F.octet_length(text) + overhead).cast("long"))
        .withColumn("_tokens", word_count(F.col("text")))
        .withColumn("_crc", F.crc32(text.cast("binary")))
        .withColumn("_group", F.xxhash64(text))
    )


def _sums(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("_size").alias("bytes"), F.sum("_tokens").alias("tokens"), F.count("*").alias("rows"))


def pack(demands: np.ndarray, shards: int, weights: tuple[float, ...] = WEIGHTS, capacity: np.ndarray | None = None) -> np.ndarray:
    """The shard of each item. ``capacity``: what each shard has for these items, in the units of the demands; the same for all if None.

    Demands and residuals are in parts of a mean shard, per dimension; the dot product is weighted.
    """
    total = demands.sum(axis=0)
    unit = np.where(total > 0, total / shards, 1)
    demands = demands / unit
    residual = np.ones((shards, demands.shape[1])) if capacity is None else capacity / unit
    out = np.empty(len(demands), dtype=np.int64)
    for i in np.lexsort((np.arange(len(demands)), -demands.max(axis=1))):
        out[i] = best = int(np.argmax(np.round(residual @ (demands[i] * weights), 12)))
        residual[best] -= demands[i]
    return out


def _packing(shards: int, left: np.ndarray):
    """Packs a block; ``left`` is the capacity that the large groups left, in the dimensions' units."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows["_group"].to_numpy(), kind="stable")))
        demands = np.stack([rows[d].to_numpy().astype(float) for d in DIMENSIONS], axis=1)
        open_ = np.maximum(left, 0)
        part = open_ / np.where(open_.sum(axis=0) > 0, open_.sum(axis=0), 1)
        where = pack(demands, shards, capacity=part * demands.sum(axis=0))
        return pa.table({"_group": rows["_group"], "_shard": pa.array(where.astype(np.int32))})

    return run


def placed(narrow: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Staged tables of the shard of each (_group, _salt), and of the salts of the groups that have several: (_group, _salts, _pieces).

    ``narrow``: a staged table of doc_id, _size, _tokens, _group.
    """
    spark = narrow.sparkSession
    groups = staged(_sums(narrow, "_group"), "sums")
    n, *total = groups.agg(F.count("*"), *[F.sum(d) for d in DIMENSIONS]).first()
    share = np.maximum(np.array([float(t or 0) for t in total]) / shards * LARGEST, 1e-9)
    part = F.greatest(*[F.col(d) / F.lit(float(share[k])) for k, d in enumerate(DIMENSIONS)])
    pieces = F.when(part * LARGEST > CUT, F.ceil(part)).otherwise(1).cast("int")
    tasks = F.greatest(F.col("rows") / SALT, F.col("bytes") / SALT_BYTES)
    cut = groups.withColumn("_heavy", part > 1).where(F.col("_heavy") | (tasks > 1)).withColumn("_pieces", pieces)
    cut = staged(cut.select("_group", "_heavy", "_pieces", (F.col("_pieces") * F.ceil(tasks / F.col("_pieces"))).cast("int").alias("_salts")), "cut")
    exact = _sums(salted(narrow.join(F.broadcast(cut.where("_heavy")), "_group")).withColumn("_piece", F.col("_salt") % F.col("_pieces")), "_group", "_piece").collect()
    exact.sort(key=lambda r: tuple(r[:2]))
    capacity = np.tile(np.array([float(t or 0) for t in total]) / shards, (shards, 1))
    demands = np.array([r[2:] for r in exact], dtype=float).reshape(-1, len(DIMENSIONS))
    where = pack(demands / (share / LARGEST), shards, capacity=capacity / (share / LARGEST)) if len(exact) else np.empty(0, dtype=int)
    np.subtract.at(capacity, where, demands)
    heavy = spark.createDataFrame([(*r[:2], int(s)) for r, s in zip(exact, where)], "_group long, _piece int, _shard int")
    salts = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    of_heavy = cut.where("_heavy").withColumn("_salt", salts).withColumn("_piece", F.col("_salt") % F.col("_pieces"))
    of_heavy = of_heavy.join(F.broadcast(heavy), ["_group", "_piece"]).select("_group", "_salt", "_shard")
    rest = groups.join(F.broadcast(cut.where("_heavy").select("_group")), "_group", "left_anti").withColumn("_block", F.pmod(F.xxhash64(F.lit("block"), "_group"), F.lit(n // BLOCK + 1)))
    packed = rest.groupBy("_block").applyInArrow(_packing(shards, capacity), "_group long, _shard int")
    several = small(cut.where("NOT _heavy").select("_group", "_salts"))
    packed = packed.join(several, "_group", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1))).withColumn("_salt", salts)
    out = staged(packed.select("_group", "_salt", "_shard").union(of_heavy), "placed")
    unstage(groups)
    return out, cut


def salted(rows: DataFrame) -> DataFrame:
    """Adds _salt to rows with _salts, their group's number of them."""
    return rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit("salt"), "doc_id"), F.coalesce("_salts", F.lit(1))).cast("int"))


def first_slots(parts: DataFrame) -> DataFrame:
    """Staged: ``parts`` (staged; _group, _salt, _shard and _n, its rows) with ``_first``, the number of rows in the parts before it in its shard.

    Parts are dealt to bins by hash; the windows are over the bins of a shard and over the parts of a bin.
    """
    binned = parts.withColumn("_bin", F.pmod(F.xxhash64(F.lit("bin"), "_group", "_salt"), F.lit(parts.count() // BLOCK + 1)))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = binned.groupBy("_shard", "_bin").agg(F.sum("_n").alias("_n"))
    bins = staged(bins.select("_shard", "_bin", before(Window.partitionBy("_shard").orderBy("_bin")).alias("_start")), "bins")
    within = before(Window.partitionBy("_shard", "_bin").orderBy("_group", "_salt"))
    out = staged(binned.join(small(bins), ["_shard", "_bin"]).select("_group", "_salt", "_shard", (F.col("_start") + within).alias("_first")), "slots")
    unstage(bins)
    return out


def assign(rows: DataFrame, narrow: DataFrame, shards: int) -> DataFrame:
    """``rows`` with ``_shard`` and ``_slot``; both have doc_id and _group, ``narrow`` is staged and has the columns of ``measured``."""
    where, cut = placed(narrow, shards)
    several = small(cut.select("_group", "_salts"))
    with_salt = lambda df: salted(df.join(several, "_group", "left"))
    counts = with_salt(narrow).groupBy("_group", "_salt").agg(F.count("*").alias("_n"))
    parts = staged(counts.join(where, ["_group", "_salt"]), "parts")
    slots = first_slots(parts)
    unstage(where, parts)
    nth = F.row_number().over(Window.partitionBy("_group", "_salt").orderBy("doc_id"))  # of a part's rows, which all have one text
    return with_salt(rows).join(slots, ["_group", "_salt"]).withColumn("_slot", F.col("_first") + nth - 1).drop("_salts", "_salt", "_first")


RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _result(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "size": F.col("_size"), "text_crc32": F.col("_crc"), "law": F.lit("bytes"), "shard": F.col("_shard").cast("int"),
        "slot": F.col("_slot").cast("long"), "grown_shard": F.lit(None).cast("int"),
    })


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard. Texts are moved once, to the tasks of their groups, and aren't staged."""
    kept = [c for c in docs.columns if c not in RESULT]
    rows = measured(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), "doc_id", "text")).drop("text")
    narrow = staged(rows.select("doc_id", "_size", "_tokens", "_group"), "measured")
    return _result(assign(rows.drop("_tokens"), narrow, shards)).select("_row.*", *RESULT)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = staged(measured(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "measured")
    return _result(assign(docs.drop("_tokens"), docs, 40)).select("doc_id", *RESULT)
