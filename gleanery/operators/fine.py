"""Second stages of the searches: candidates of the coarse stage are matched, gated and ranked again.

Matches of keypoint sets come in as a relation, made by a model at the boundary
(``operators/models.py``); what is done with them is declared here. All is per query:
a query has at most a few hundred patches and the coarse stage's bounded number of images.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry, image
from . import ranking

#: Fewest inliers of a query of one or two patches, and of a larger one; fewest keypoints of a patch.
OBJECT_INLIERS, SCENE_INLIERS, LEAST_KEYPOINTS = 3, 15, 4


def objects(candidates: DataFrame, matched: DataFrame, k: int, take: int = 20, least: float = 0.5) -> DataFrame:
    """``query_id``, ``rank``, ``image_id``, ``path``, ``score``, ``inlier_ratio``, ``overlap``, ``confidence``.

    ``candidates``: query_id, image_id, path, score, rank (coarse), overlap. ``matched``: query_id, image_id, keypoints,
    matches, inliers. Of the first ``take`` candidates the first ``k`` that could be matched are taken, in coarse order,
    and only then ranked by confidence; a candidate without a row in ``matched`` or without keypoints takes no place.
    Both scores must reach ``least``, and a path is named once. Ties keep the coarse order."""
    per_query = Window.partitionBy("query_id")
    usable = candidates.filter(F.col("rank") <= take).join(matched.filter("keypoints > 0"), ["query_id", "image_id"])
    taken = usable.withColumn("place", F.row_number().over(per_query.orderBy("rank"))).filter(F.col("place") <= k)
    ratio = F.coalesce(F.try_divide(F.col("inliers").cast("double"), "matches"), F.lit(0.0))
    scored = taken.withColumn("inlier_ratio", ratio).withColumn("confidence", ranking.fusion(F.col("score"), F.col("inlier_ratio"), F.col("overlap")))
    good = scored.filter((F.col("score") >= least) & (F.col("confidence") >= least)).withColumn("order", F.round("confidence", 9))
    once = good.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "path").orderBy(F.desc("order"), "place"))).filter("n = 1")
    ranked = once.withColumn("rank", F.row_number().over(per_query.orderBy(F.desc("order"), "place")))
    return ranked.select("query_id", "rank", "image_id", "path", "score", "inlier_ratio", "overlap", "confidence")


def richest(patches: DataFrame, query: str, most: int = 50) -> DataFrame:
    """A query's patches with the most keypoints, those of equal number in order of ``patch_index``."""
    w = Window.partitionBy(query).orderBy(F.desc("num_keypoints"), "patch_index")
    return patches.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def patch_pairs(query: DataFrame, candidates: DataFrame, patches: DataFrame, overlap: float = 0.3) -> DataFrame:
    """Which patches to match: ``query_image``, ``image_id``, ``coarse``, ``query_patch``, ``patch``, ``overlap``, ``cx``, ``cy``.

    ``query``: query_image, id, patch_index, num_keypoints, x, y, w, h. ``candidates``: query_image, image_id, votes.
    ``patches``: image_id, id, patch_index, num_keypoints, x, y, w, h. Patches of few keypoints, and those that lie
    elsewhere in their image, are left out. ``candidates`` bounds what the joins give for a query."""
    box = ("x", "y", "w", "h")
    own = query.filter(F.col("num_keypoints") >= LEAST_KEYPOINTS)
    own = own.select("query_image", F.col("id").alias("query_patch"), *[F.col(c).alias(f"q{c}") for c in box])
    them = patches.filter(F.col("num_keypoints") >= LEAST_KEYPOINTS).select("image_id", F.col("id").alias("patch"), "patch_index", *box)
    met = geometry.iou_xywh(*[F.col(f"q{c}") for c in box], *[F.col(c) for c in box])
    pairs = candidates.select("query_image", "image_id", F.col("votes").alias("coarse")).join(them, "image_id").join(own, "query_image")
    centre = [(F.col(f"q{a}") + F.col(f"q{s}") * 0.5).alias(f"c{a}") for a, s in (("x", "w"), ("y", "h"))]
    return pairs.withColumn("overlap", met).filter(F.col("overlap") >= overlap).select("query_image", "image_id", "coarse", "query_patch", "patch", "patch_index", "overlap", *centre)


def patches(pairs: DataFrame, matched: DataFrame, query: DataFrame, k: int, object_inliers: int = OBJECT_INLIERS, scene_inliers: int = SCENE_INLIERS) -> DataFrame:
    """``query_image``, ``rank``, ``image_id``, ``inliers``, ``matches``, ``matched``, ``confidence``.

    ``pairs`` as of ``patch_pairs``; ``matched``: query_patch, patch, matches, inliers, color (shared colour of the two).
    Each query patch counts with its best candidate (the first of equals; none without inliers). A query of at most
    two patches is an object, else a scene: they differ in the fewest inliers and in the confidence. Ties of objects
    go by the number of matched patches, then, as those of scenes, by image."""
    both = pairs.join(matched, ["query_patch", "patch"])
    best = both.filter("inliers > 0").groupBy("query_image", "image_id", "query_patch").agg(
        F.max_by(F.struct("inliers", "matches", "color", "overlap", "cx", "cy"), F.struct("inliers", -F.col("patch_index"))).alias("best")
    )
    size = query.groupBy("query_image").agg(F.count("*").alias("size"))
    best = best.select("query_image", "image_id", "query_patch", "best.*").join(size, "query_image")
    enough = best.filter(F.col("inliers") >= F.when(F.col("size") <= 2, object_inliers).otherwise(scene_inliers))
    per_image = enough.groupBy("query_image", "image_id").agg(
        F.sum("inliers").alias("inliers"), F.sum("matches").alias("matches"), F.count("*").alias("matched"), F.sum("color").alias("color"),
        F.sum("overlap").alias("overlap"), geometry.spatial_variance(F.col("cx"), F.col("cy")).alias("variance"), F.max("size").alias("size"),
    )
    c = F.col
    sums = (c("inliers"), c("matches"), c("matched"))
    as_object = ranking.object_confidence(*sums, c("color"), c("overlap"), c("size"))
    as_scene = ranking.scene_confidence(*sums, c("matched"), c("variance"), c("color"), c("overlap"))
    scored = per_image.withColumn("confidence", F.when(c("size") <= 2, as_object).otherwise(as_scene))
    w = Window.partitionBy("query_image").orderBy(F.desc(F.round("confidence", 9)), F.when(c("size") <= 2, -c("matched")), "image_id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_image", "rank", "image_id", "inliers", "matches", "matched", "confidence")


def query_face(faces: DataFrame, query: str, pose: float = 0.5) -> DataFrame:
    """Of each query image the largest face that passes the gates, the first of equals; an image without one gives no row.

    ``faces``: the query's key, face, score, x1, y1, x2, y2, the eyes as ax, ay, bx, by, and what else is to come along."""
    c = F.col
    inside = F.lit(True)
    for e in "ab":
        inside = inside & c(f"{e}x").between(c("x1") - 50, c("x2") + 50) & c(f"{e}y").between(c("y1") - 50, c("y2") + 50)
    w, h = c("x2") - c("x1"), c("y2") - c("y1")
    reason = image.reject_reason(c("score"), image.area_score(w, h), geometry.eye_distance(c("ax"), c("ay"), c("bx"), c("by")), F.lit(pose), inside)
    best = F.max_by(F.struct(*faces.columns), F.struct(w * h, -c("face")))
    return faces.filter(reason.isNull()).groupBy(query).agg(best.alias("best")).select("best.*")
