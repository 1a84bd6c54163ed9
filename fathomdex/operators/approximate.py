"""An approximate search, for those who ask for it: random projections into buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def approximate_top_k(items: DataFrame, query: Sequence[float], k: int, keys: Sequence[str], vector: str = "vector", tables: int = 8, width: float = 1.0) -> DataFrame:
    """(*keys, score) of up to k vectors that share a bucket with the query. Vectors must be of length 1; some neighbours may be missed."""
    rows = items.select(*keys, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", numHashTables=tables, bucketLength=width, seed=7).fit(rows)
    found = model.approxNearestNeighbors(rows, Vectors.dense(list(query)), k, distCol="_d")
    return found.select(*keys, (1 - F.col("_d") * F.col("_d") / 2).alias("score"))
