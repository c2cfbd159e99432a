"""The searches from query to ranked result: coarse stage, matches, gates, final ranking. ``embeddings`` gives the vectors, arithmetic on ids the boxes and match counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import fine, knn, ranking
from .registry import query
from .similarity import EVERY_20TH, RANKED, THRESHOLD, UNIT, every_20th, labelled, r, vectors

OBJECTS, TAKE, LEAST = 12, 10, 0.15
IOU = """CASE WHEN least({a}x + {a}w, {b}x + {b}w) > greatest({a}x, {b}x) AND least({a}y + {a}h, {b}y + {b}h) > greatest({a}y, {b}y) THEN
    ((least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x)) * (least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y)))::DOUBLE
    / ({a}w * {a}h + {b}w * {b}h - (least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x)) * (least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y))) ELSE 0.0::DOUBLE END"""
BOX = "{id} * 17 % 50 AS x, {id} * 29 % 40 AS y, 60 AS w, 50 + {id} % 20 AS h"


def _boxed(df: DataFrame, of: str) -> DataFrame:
    """A box from an id."""
    i = F.col(of)
    return df.withColumn("x", i * 17 % 50).withColumn("y", i * 29 % 40).withColumn("w", F.lit(60).cast("long")).withColumn("h", 50 + i % 20)


@query(
    f"""WITH {UNIT.format(which=EVERY_20TH)}, {RANKED}, found AS (SELECT query_id, id // 4 AS image_id, id, score FROM ranked WHERE rank <= {3 * OBJECTS} AND score > 0),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id, image_id ORDER BY score DESC, id) AS n FROM found),
    coarse AS (SELECT query_id, image_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) AS rank, {BOX.format(id="id")}, 0 AS qx, 0 AS qy, 100 AS qw, 80 AS qh FROM best WHERE n = 1),
    fit AS (SELECT *, {IOU.format(a="q", b="")} AS overlap, (image_id * 13 + query_id * 7) % 60 AS matches, (image_id * 13 + query_id * 7) % 60 * ((image_id * 7 + query_id) % 11) // 10 AS inliers FROM coarse
        WHERE rank <= {TAKE} AND image_id % 9 <> 4 AND (image_id + query_id // 20) % 7 <> 0),
    taken AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM fit),
    scored AS (SELECT *, CASE WHEN matches > 0 THEN inliers / matches ELSE 0 END AS ratio FROM taken WHERE place <= 5),
    good AS (SELECT *, 0.3 * score + 0.5 * ratio + 0.2 * overlap AS confidence, image_id % 50 AS path FROM scored WHERE score >= {LEAST} AND 0.3 * score + 0.5 * ratio + 0.2 * overlap >= {LEAST}),
    once AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY round(confidence, 9) DESC, place) AS n2 FROM good)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(confidence, 9) DESC, place) AS rank, image_id, path, round(ratio, 6) AS inlier_ratio, round(overlap, 6) AS overlap, round(confidence, 6) AS confidence FROM once WHERE n2 = 1"""
)
def object_search_fine(spark, sf_dir):
    """Object search to its end: every vector is an object, four an image; some images cannot be read, some have no keypoints."""
    v = vectors(spark, sf_dir)
    found = knn.search(v, every_20th(v), k=3 * OBJECTS).withColumn("image_id", F.floor(F.col("id") / 4))
    q, i = F.col("query_id"), F.col("image_id")
    coarse = _boxed(ranking.coarse_objects(found, "image_id", OBJECTS), "id").withColumn("path", i % 50)
    whole = [F.lit(x) for x in (0, 0, 100, 80)]
    candidates = coarse.withColumn("overlap", geometry.iou_xywh(*whole, *[F.col(c) for c in "xywh"]))
    n = (i * 13 + q * 7) % 60
    matched = candidates.filter(i % 9 != 4).select("query_id", "image_id", (((i + F.floor(q / 20)) % 7 != 0).cast("int") * 8).alias("keypoints"), n.alias("matches"), F.floor(n * ((i * 7 + q) % 11) / 10).alias("inliers"))
    out = fine.objects(candidates, matched, 5, TAKE, LEAST)
    return out.select("query_id", F.col("rank"), "image_id", "path", r("inlier_ratio").alias("inlier_ratio"), r("overlap").alias("overlap"), r("confidence").alias("confidence"))


PATCHES = f"""p AS (SELECT vec_id AS id, vec_id // 8 AS image_id, vec_id % 8 AS patch_index, vec_id * 31 % 40 AS num_keypoints, {BOX.format(id="vec_id")}, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT *, image_id AS query_image FROM p WHERE image_id % 20 = 0 AND (image_id % 40 = 0 OR patch_index < 2)),
rich AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_image ORDER BY num_keypoints DESC, patch_index) AS n FROM q) WHERE n <= 5)"""


def _patches(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir)
    i = F.col("id")
    return _boxed(v.select("id", F.floor(i / 8).alias("image_id"), (i % 8).alias("patch_index"), (i * 31 % 40).alias("num_keypoints"), "vector"), "id")


def _query_patches(p: DataFrame) -> DataFrame:
    i = F.col("image_id")
    return p.filter((i % 20 == 0) & ((i % 40 == 0) | (F.col("patch_index") < 2))).withColumn("query_image", i)


@query(f"WITH {PATCHES} SELECT query_image, n, id, num_keypoints FROM rich")
def richest_patches(spark, sf_dir):
    """Of a query image the five patches with the most keypoints."""
    from pyspark.sql.window import Window

    rich = fine.richest(_query_patches(_patches(spark, sf_dir)), "query_image", 5)
    w = Window.partitionBy("query_image").orderBy(F.desc("num_keypoints"), "patch_index")
    return rich.select("query_image", F.row_number().over(w).alias("n"), "id", "num_keypoints")


@query(
    f"""WITH {PATCHES}, s AS (SELECT rich.query_image, rich.id AS query_id, p.id, p.image_id, list_cosine_similarity(rich.v, p.v) AS score FROM rich JOIN p ON true),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s) WHERE n <= 50),
    b AS (SELECT query_image, query_id, image_id, max(greatest(score, 0)) AS best FROM near GROUP BY ALL), c AS (SELECT query_image, image_id, sum(best) AS votes FROM b GROUP BY ALL),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_image ORDER BY round(votes, 9) DESC, image_id) AS n FROM c) WHERE n <= 20),
    pairs AS (SELECT q.query_image, q.id AS query_patch, p.id AS patch, p.image_id, p.patch_index, q.x + q.w * 0.5 AS cx, q.y + q.h * 0.5 AS cy, {IOU.format(a="q.", b="p.")} AS overlap
        FROM top JOIN p ON p.image_id = top.image_id JOIN q ON q.query_image = top.query_image WHERE p.num_keypoints >= 4 AND q.num_keypoints >= 4),
    m AS (SELECT *, (query_patch * 7 + patch * 13) % 60 AS matches, (query_patch * 7 + patch * 13) % 60 * ((query_patch + patch) % 11) // 10 AS inliers, ((query_patch * 3 + patch * 5) % 100) / 100.0 AS color FROM pairs WHERE overlap >= 0.3),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_image, image_id, query_patch ORDER BY inliers DESC, patch_index) AS n FROM m WHERE inliers > 0) WHERE n = 1),
    size AS (SELECT query_image, count(*) AS size FROM q GROUP BY query_image),
    agg AS (SELECT query_image, image_id, size, sum(inliers)::BIGINT AS inliers, sum(matches)::BIGINT AS matches, count(*) AS matched, 0.5 + 0.5 * avg(color)::DOUBLE AS color, 0.5 + 0.5 * avg(overlap) AS lap, var_pop(cx::DOUBLE) + var_pop(cy::DOUBLE) AS variance
        FROM one JOIN size USING (query_image) WHERE inliers >= CASE WHEN size <= 2 THEN 3 ELSE 15 END GROUP BY ALL),
    scored AS (SELECT *, CASE WHEN size <= 2 THEN inliers / matches * sqrt(inliers) * (1 + 0.5 * matched / size) * color * lap
        ELSE inliers / matches * inliers * CASE WHEN matched >= 3 THEN greatest(1 - variance, 0.3) ELSE 1 END * greatest(ln(1 + matched), 1) * color * lap END AS confidence FROM agg),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_image ORDER BY round(confidence, 9) DESC, CASE WHEN size <= 2 THEN -matched END, image_id) AS rank FROM scored)
    SELECT query_image, rank, image_id, inliers, matches, matched, round(confidence, 5) AS confidence FROM ranked WHERE rank <= 10"""
)
def patch_search_fine(spark, sf_dir):
    """Patch search to its end, queries of two patches (objects) and of eight (scenes)."""
    p = _patches(spark, sf_dir)
    own = _query_patches(p)
    rich = fine.richest(own, "query_image", 5)
    found = knn.search(p, rich, k=50).join(p.select("id", "image_id"), "id")
    found = found.join(rich.select(F.col("id").alias("query_id"), "query_image"), "query_id")
    candidates = ranking.coarse_patches(found, "image_id", "query_image").withColumn("order", -F.round("votes", 9))
    top = ranking.first_per_key(candidates, "query_image", "order", "image_id", most=20)
    pairs = fine.patch_pairs(own, top, p)
    a, b = F.col("query_patch"), F.col("patch")
    n = (a * 7 + b * 13) % 60
    matched = pairs.select("query_patch", "patch", n.alias("matches"), F.floor(n * ((a + b) % 11) / 10).alias("inliers"), ((a * 3 + b * 5) % 100 / 100).alias("color")).distinct()
    return fine.patches(pairs, matched, own, 10).withColumn("confidence", r("confidence", 5))


@query(
    f"""WITH f AS (SELECT vec_id AS id, vec_id // 60 AS image, vec_id // 20 AS n, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0),
    g AS (SELECT *, (n * 37 % 100) / 100.0 AS det, 10 + n * 13 % 90 AS w, 15 + n * 29 % 80 AS h, n * 7 % 40 AS eyes, CASE WHEN n % 3 = 0 THEN 60 ELSE 5 END AS off FROM f),
    kept AS (SELECT * FROM g WHERE det >= CASE WHEN off <= 50 THEN 0.3 ELSE 0.45 END AND least(w, h) / 150.0 >= 0.15 AND eyes >= 12),
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY w * h DESC, id) AS k FROM kept) WHERE k = 1),
    s AS (SELECT image, one.id AS face, label, vec_id AS id, list_cosine_similarity(v, CAST(embedding AS DOUBLE[])) AS score FROM one JOIN embeddings ON true),
    best AS (SELECT *, row_number() OVER (PARTITION BY image, label ORDER BY score DESC, id) AS k FROM s WHERE score >= {THRESHOLD})
    SELECT image, face, label, id, round(score, 6) AS score FROM best WHERE k = 1"""
)
def person_search_gated(spark, sf_dir):
    """Person search from query images: of three faces each the largest that passes the gates is looked for."""
    v = vectors(spark, sf_dir)
    n = F.floor(F.col("id") / 20)
    faces = every_20th(v).select(F.floor(F.col("id") / 60).alias("image"), F.col("id").alias("face"), n.alias("n"), "vector")
    n = F.col("n")
    left = 5 - F.when(n % 3 == 0, 65).otherwise(10)
    faces = faces.select(
        "image", "face", "vector", (n * 37 % 100 / 100).alias("score"), F.lit(5).alias("x1"), F.lit(5).alias("y1"), (15 + n * 13 % 90).alias("x2"), (20 + n * 29 % 80).alias("y2"),
        (left + 5).alias("ax"), F.lit(6).alias("ay"), (left + 5).alias("bx"), (6 + n * 7 % 40).alias("by"),
    )
    chosen = fine.query_face(faces, "image").select(F.col("face").alias("id"), "image", "vector")
    found = labelled(knn.search(v, chosen, least=THRESHOLD), v)
    best = knn.best_per_group(found, "label").join(chosen.select(F.col("id").alias("query_id"), "image"), "query_id")
    return best.select("image", F.col("query_id").alias("face"), "label", "id", r("score").alias("score"))
