"""Aggregation of local descriptors: nearest centroid, residuals, mean and spread, k-means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector
from . import knn


def _check(centroids: DataFrame) -> None:
    n, dim = centroids.agg(F.count("*"), F.max(F.size("centroid"))).first()
    if n * (dim or 0) > knn.QUERY_FLOATS:
        raise ValueError(f"{n} centroids of {dim} values are too many to send to every task")


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``id``, ``k``, ``distance`` (squared) of the nearest centroid, ties by the smaller ``k``.

    ``centroids`` (``k``, ``centroid``) is a trained table of K rows; its size is checked before it is sent to every task."""
    _check(centroids)
    table = F.broadcast(centroids.groupBy().agg(F.array_sort(F.collect_list(F.struct("k", "centroid"))).alias("table")))
    near = F.transform("table", lambda c: F.struct(vector.squared_distance(F.col("vector"), c["centroid"]).alias("distance"), c["k"].alias("k")))
    return vectors.join(table).select(*vectors.columns, F.array_min(near).alias("near")).select(*vectors.columns, "near.k", "near.distance")


def residuals(assigned: DataFrame, centroids: DataFrame, key: str) -> DataFrame:
    """``key``, ``k``, ``dim``, ``residual``: sums of what vectors differ from their centroid, not yet scaled."""
    _check(centroids)
    joined = assigned.join(F.broadcast(centroids), "k")
    each = joined.select(key, "k", F.posexplode(F.zip_with(vector.doubles(F.col("vector")), vector.doubles(F.col("centroid")), lambda x, c: x - c)).alias("dim", "x"))
    return each.groupBy(key, "k", "dim").agg(F.sum("x").alias("residual"))


def vlad(assigned: DataFrame, centroids: DataFrame, key: str) -> DataFrame:
    """``key`` and its K x dim residuals scaled to unit length; centroids that nothing fell to are 0."""
    r = residuals(assigned, centroids, key)
    length = r.groupBy(key).agg(F.sqrt(F.sum(F.col("residual") * F.col("residual"))).alias("length"))
    scaled = r.join(length, key).select(key, "k", "dim", F.when(F.col("length") > 1e-10, F.col("residual") / F.col("length")).otherwise(0.0).alias("value"))
    return scaled


def kmeans(vectors: DataFrame, k: int, iterations: int = 20, seed: int = 42):
    """The library's own distributed k-means over all rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = vectors.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return KMeans(k=k, maxIter=iterations, seed=seed, initMode="k-means||").fit(own)
