"""Vector expressions on ``ARRAY<FLOAT>`` columns. Everything is computed in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """NULL if the lengths differ: ``zip_with`` pads with NULL, which the sum keeps."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def total(a: Column) -> Column:
    return F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, floor: float = 0.0) -> Column:
    """0 where either norm is not above ``floor``."""
    na, nb = norm(a), norm(b)
    return F.when((na > floor) & (nb > floor), dot(a, b) / (na * nb)).otherwise(0.0)


def cosine_clamped(a: Column, b: Column) -> Column:
    """Norms floored at 1e-10, the result within [-1, 1]."""
    least = F.lit(1e-10)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (F.greatest(norm(a), least) * F.greatest(norm(b), least))))


def normalized(a: Column, floor: float = 1e-8) -> Column:
    """Unit length; unchanged where the norm is not above ``floor``."""
    n = norm(a)
    return F.when(n > floor, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def early_exit(na: Column, a: Column, nb: Column, b: Column, max_difference: int, least_similarity: float) -> Column:
    """Whether a pair can be skipped: counts too far apart, or mean descriptors of one size too unlike."""
    return F.when(F.abs(na - nb) > max_difference, True).when(F.size(a) != F.size(b), False).otherwise(dot(a, b) < least_similarity)


def mean_components(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key``, ``n`` and the mean per component as an array, summed map-side; vectors of NULL are left out."""
    each = df.filter(F.col(vector).isNotNull()).select(key, F.posexplode(doubles(F.col(vector))).alias("dim", "x"))
    means = each.groupBy(key, "dim").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"])
    return means.groupBy(key).agg(F.max("n").alias("n"), ordered.alias("mean"))


def prototypes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean then unit length; a single vector stays as it is."""
    m = mean_components(df, key, vector)
    return m.select(key, "n", F.when(F.col("n") == 1, F.col("mean")).otherwise(normalized(F.col("mean"))).alias("prototype"))
