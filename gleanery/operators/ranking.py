"""Votes, fusion scores and confidences of the two-stage searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def coarse_objects(found: DataFrame, image: str, k: int) -> DataFrame:
    """From the 3k best objects: each image's best positive score and that object's ``id``, the best k images (ties by image)."""
    first = F.max_by("id", F.struct("score", -F.col("id"))).alias("id")
    best = found.filter((F.col("rank") <= 3 * k) & (F.col("score") > 0)).groupBy("query_id", image).agg(F.max("score").alias("score"), first)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), image)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def coarse_patches(found: DataFrame, image: str, *query: str) -> DataFrame:
    """Per image (and ``query``, where several are asked at once), over query patches: the sum and number of each patch's best score, not below 0."""
    best = found.groupBy(*query, "query_id", image).agg(F.max(F.greatest("score", F.lit(0.0))).alias("best"))
    return best.groupBy(*query, image).agg(F.sum("best").alias("votes"), F.count("*").alias("n_patches"))


def fusion(embedding: Column, inlier_ratio: Column, overlap: Column) -> Column:
    return embedding * 0.3 + inlier_ratio * 0.5 + overlap * 0.2


def _multipliers(color: Column, overlap: Column, matched: Column) -> Column:
    each = lambda x: 0.5 + 0.5 * F.coalesce(F.try_divide(x, matched), F.lit(0.0))
    return each(color) * each(overlap)


def object_confidence(inliers: Column, matches: Column, matched: Column, color: Column, overlap: Column, patches: Column | int = 1) -> Column:
    """For queries of one or two patches, ``patches`` in all; ``color`` and ``overlap`` are sums over matched query patches."""
    ratio = F.coalesce(F.try_divide(inliers.cast("double"), matches), F.lit(0.0))
    return ratio * F.sqrt(inliers.cast("double")) * (1 + 0.5 * matched / patches) * _multipliers(color, overlap, matched)


def scene_confidence(inliers: Column, matches: Column, matched: Column, centres: Column, variance: Column, color: Column, overlap: Column) -> Column:
    """For larger queries: matches that lie together count more, from three centres on."""
    ratio = F.coalesce(F.try_divide(inliers.cast("double"), matches), F.lit(0.0))
    together = F.when(centres >= 3, F.greatest(1 - variance, F.lit(0.3))).otherwise(1.0)
    return inliers * ratio * together * F.greatest(F.log(1 + matched.cast("double")), F.lit(1.0)) * _multipliers(color, overlap, matched)


def best_candidate(df: DataFrame, query: str, image: str, candidate: str, score: str) -> DataFrame:
    """The first best candidate per query patch and image; a score of 0 never wins."""
    w = Window.partitionBy(query, image).orderBy(F.desc(score), candidate)
    return df.filter(F.col(score) > 0).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_per_key(df: DataFrame, key: str, *order: Column | str, most: int = 1) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")
