"""Smaller operators: keypoints, class scores, alignment, sampling, counters and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry, image, keypoints, vector
from ..sources import files as folder
from .boxes import SIZES, sizes
from .pixels import LUMINANCE, PIXELS, pixels, rgb
from .registry import query, table
from .similarity import ASSIGNED, _centroids, r, vectors


@query("WITH s AS (SELECT vec_id, embedding AS v FROM embeddings) SELECT vec_id, CASE WHEN list_max(v) > 0 THEN list_position(v, list_max(v)) - 1 ELSE 0 END::INT AS class, round(greatest(list_max(v)::DOUBLE, 0), 6) AS score FROM s")
def class_argmax(spark, sf_dir):
    own = vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), keypoints.best_class(vector.doubles(F.col("vector"))).alias("x"))
    return own.select("vec_id", "x.class", r("x.score").alias("score"))


@query(
    """WITH k AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
    n AS (SELECT vec_id, i, 2 * ((x + 1) * 128) / CASE WHEN i % 2 = 0 THEN 256 ELSE 512 END - 1 AS unit, CASE WHEN i % 2 = 0 THEN (10 + (x + 1) * 128 / 256 * 100) / 640 ELSE (20 + (x + 1) * 128 / 256 * 50) / 480 END AS share FROM k)
    SELECT vec_id, round(sum(unit), 6) AS unit, round(sum(share), 6) AS share FROM n GROUP BY vec_id"""
)
def keypoint_transform(spark, sf_dir):
    """A vector's components as x, y pairs within a patch of 256 pixels."""
    flat = F.transform(vector.doubles(F.col("vector")), lambda x: (x + 1) * 128)
    box = F.struct(*[F.lit(v).alias(n) for n, v in (("x", 10), ("y", 20), ("w", 100), ("h", 50))])
    own = vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), keypoints.normalized(flat, F.lit(256), F.lit(512)).alias("u"), keypoints.in_image(flat, box, F.lit(640), F.lit(480)).alias("s"))
    return own.select("vec_id", r(vector.total(F.col("u"))).alias("unit"), r(vector.total(F.col("s"))).alias("share"))


@query(
    """WITH k AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS n FROM k)
    SELECT vec_id, count(*) AS kept, round(sum(x), 6) AS total, sum(i)::BIGINT AS places FROM n WHERE n <= 16 GROUP BY vec_id"""
)
def strongest_keypoints(spark, sf_dir):
    points = F.transform(vector.doubles(F.col("vector")), lambda x, i: F.struct(x.alias("score"), i.alias("i")))
    own = vectors(spark, sf_dir).select(F.col("id").alias("vec_id"), keypoints.strongest(points, 16).alias("p"))
    sums = F.aggregate("p", F.struct(F.lit(0.0).alias("t"), F.lit(0).cast("long").alias("i")), lambda s, p: F.struct((s["t"] + p["score"]).alias("t"), (s["i"] + p["i"]).alias("i")))
    return own.select("vec_id", F.size("p").cast("long").alias("kept"), sums.alias("s")).select("vec_id", "kept", r("s.t").alias("total"), F.col("s.i").alias("places"))


@query(
    """WITH d AS (SELECT l_orderkey AS image, l_linenumber AS det, l_partkey % 640 AS cx, l_suppkey * 37 % 640 AS cy, l_quantity AS w, l_quantity * 1.5 AS h, l_discount * 10 AS p FROM lineitem),
    b AS (SELECT *, least(greatest((cx - w / 2) * 2, 0), 1280) AS x1, least(greatest((cy - h / 2) * 1.5, 0), 960) AS y1, least(greatest((cx + w / 2) * 2, 0), 1280) AS x2, least(greatest((cy + h / 2) * 1.5, 0), 960) AS y2 FROM d WHERE p >= 0.25)
    SELECT image, det, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM b WHERE x2 - x1 >= 20 AND y2 - y1 >= 20"""
)
def centre_box_decode(spark, sf_dir):
    """Boxes by centre and size, of at least some confidence, scaled to the image, clipped, and not too small."""
    q = F.col("l_quantity")
    own = table(spark, sf_dir, "lineitem").filter(F.col("l_discount") * 10 >= 0.25)
    box = geometry.centre_box(F.col("l_partkey") % 640, F.col("l_suppkey") * 37 % 640, q, q * 1.5, F.lit(2.0), F.lit(1.5), F.lit(1280.0), F.lit(960.0))
    own = own.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("det"), *[v.alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), box, strict=True)])
    return own.filter("x2 - x1 >= 20 and y2 - y1 >= 20").select("image", "det", *[r(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    f"""WITH {PIXELS}, m AS (SELECT image, r % 112 AS x, g % 112 AS y, {LUMINANCE} AS lum FROM p), i AS (SELECT * FROM m WHERE ((x - 56) / 44.8::DOUBLE) ** 2 + ((y - 53) / 53.76::DOUBLE) ** 2 <= 1),
    s AS (SELECT image, count(*) AS pixels, avg((lum > 10)::INT) AS coverage, max(lum) - min(lum) AS spread FROM i GROUP BY image), t AS (SELECT *, coverage * 0.7 + spread / 255 * 0.3 AS score FROM s)
    SELECT image, pixels, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, image) = 1 AS best FROM t"""
)
def alignment_scale(spark, sf_dir):
    """An aligned face's pixels within the mask; the best of the candidate scales (one image each here)."""
    own = pixels(spark, sf_dir).select("image", (F.col("r") % 112).alias("x"), (F.col("g") % 112).alias("y"), image.luminance(*rgb()).alias("lum"))
    own = own.filter(keypoints.in_ellipse(F.col("x"), F.col("y")))
    s = own.groupBy("image").agg(F.count("*").alias("pixels"), F.avg((F.col("lum") > 10).cast("int")).alias("coverage"), (F.max("lum") - F.min("lum")).alias("spread"))
    s = s.withColumn("score", keypoints.alignment_score(F.col("coverage"), F.col("spread")))
    best = F.broadcast(s.agg(F.max_by("image", F.struct(F.round("score", 9), -F.col("image"))).alias("top")))  # one row
    return s.join(best).select("image", "pixels", r("score").alias("score"), (F.col("image") == F.col("top")).alias("best"))


@query(
    """WITH n AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, count(*) OVER (PARTITION BY label) AS total FROM embeddings)
    SELECT label, vec_id FROM n WHERE total <= 20 OR (n % (total // 20) = 0 AND n // (total // 20) < 20)"""
)
def step_sampling(spark, sf_dir):
    """The sampling operator: of each group every (n div 20)-th descriptor, at most 20."""
    w = Window.partitionBy("label")
    own = vectors(spark, sf_dir).select("label", F.col("id").alias("vec_id"), (F.row_number().over(w.orderBy("id")) - 1).alias("n"), F.count("*").over(w).alias("total"))
    step = F.floor(F.greatest(F.col("total"), F.lit(20)) / 20)
    return own.filter((F.col("total") <= 20) | ((F.col("n") % step == 0) & (F.floor(F.col("n") / step) < 20))).select("label", "vec_id")


@query(f"WITH {ASSIGNED}, s AS (SELECT k, count(*) AS n FROM a GROUP BY k) SELECT count(*) AS clusters, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM s")
def cluster_sizes(spark, sf_dir):
    from ..operators import descriptors

    v = vectors(spark, sf_dir)
    s = descriptors.assign(v, _centroids(v)).groupBy("k").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("clusters"), F.min("n").alias("least"), F.max("n").alias("most"), r(F.avg("n")).alias("mean"))


@query("SELECT CASE WHEN l_discount * 10 > 0.8 THEN 'green' WHEN l_discount * 10 > 0.6 THEN 'yellow' ELSE 'red' END AS overlay, CASE WHEN l_discount * 10 >= 0.7 THEN 'green' WHEN l_discount * 10 >= 0.5 THEN 'yellow' ELSE 'red' END AS list, count(*) AS n FROM lineitem GROUP BY ALL")
def score_buckets(spark, sf_dir):
    s = F.col("l_discount") * 10
    return table(spark, sf_dir, "lineitem").groupBy(image.bucket(s).alias("overlay"), image.bucket(s, 0.7, 0.5, False).alias("list")).agg(F.count("*").alias("n"))


@query(f"WITH {SIZES}, c AS (SELECT image, CASE WHEN w % 50 = 0 THEN 'empty' WHEN image % 300 + w % 50 > w OR image % 200 + 40 > h THEN 'outside' END AS reason FROM i) SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM c GROUP BY ALL")
def crop_checks(spark, sf_dir):
    own = sizes(spark, sf_dir)
    reason = folder.crop_error(F.col("w"), F.col("h"), F.col("image") % 300, F.col("image") % 200, F.col("w") % 50, F.lit(40))
    return own.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    """WITH b AS (SELECT event_type AS scale, value AS s FROM events) SELECT scale, round(max(s), 6) AS most, round(avg(s), 6) AS mean, count(*) AS n, round(CASE WHEN sum(s) > 0 THEN count(*) / sum(s) ELSE 0 END, 6) AS speed FROM b GROUP BY scale"""
)
def score_stats_per_scale(spark, sf_dir):
    b = table(spark, sf_dir, "events").select(F.col("event_type").alias("scale"), F.col("value").alias("s"))
    return b.groupBy("scale").agg(r(F.max("s")).alias("most"), r(F.avg("s")).alias("mean"), F.count("*").alias("n"), r(folder.throughput(F.count("*"), F.sum("s"))).alias("speed"))


@query("WITH p AS (SELECT l_orderkey AS image, min(l_partkey) AS x1, max(l_partkey) AS x2, min(l_suppkey) AS y1, max(l_suppkey) AS y2, count(*) AS size FROM lineitem GROUP BY l_orderkey) SELECT *, x2 - x1 + 1 AS w, y2 - y1 + 1 AS h FROM p")
def pixel_bounding_box(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image"))
    box = own.agg(F.min("l_partkey").alias("x1"), F.max("l_partkey").alias("x2"), F.min("l_suppkey").alias("y1"), F.max("l_suppkey").alias("y2"), F.count("*").alias("size"))
    return box.withColumn("w", F.col("x2") - F.col("x1") + 1).withColumn("h", F.col("y2") - F.col("y1") + 1)


@query("WITH n AS (SELECT vec_id, label, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) AS s, len(embedding) AS d FROM embeddings) SELECT label, count(*) AS n, round(min(sqrt(s)), 6) AS least, round(max(sqrt(s)), 6) AS most, min(d) AS dim, count(*) FILTER (abs(s - 1) > 0.001) AS not_unit FROM n GROUP BY label")
def vector_health(spark, sf_dir):
    own = vectors(spark, sf_dir).select("label", vector.norm(F.col("vector")).alias("s"), F.size("vector").alias("d"))
    return own.groupBy("label").agg(F.count("*").alias("n"), r(F.min("s")).alias("least"), r(F.max("s")).alias("most"), F.min("d").cast("long").alias("dim"), F.count_if(F.abs(F.col("s") * F.col("s") - 1) > 0.001).alias("not_unit"))


@query(
    f"WITH {PIXELS} SELECT image, round((var_pop(r) + var_pop(g) + var_pop(b)) / 3 / 65025, 6) AS color_variance, var_pop({LUMINANCE}) BETWEEN 200 AND 6500 AS texture_ok, round(var_pop(r % 112) + var_pop(g % 112), 4) AS spread FROM p GROUP BY image"
)
def face_texture(spark, sf_dir):
    own = pixels(spark, sf_dir)
    place = geometry.spatial_variance(F.col("r") % 112, F.col("g") % 112)
    return own.groupBy("image").agg(r(image.color_variance(*rgb())).alias("color_variance"), image.texture_ok(F.var_pop(image.luminance(*rgb()))).alias("texture_ok"), r(place, 4).alias("spread"))


@query(
    f"""WITH {SIZES}, c AS (SELECT image, w, h, least(trunc(0.25 * w)::INT, w - 1) AS x, least(trunc(0.999 * h)::INT, h - 1) AS y FROM i)
    SELECT image, x, y, greatest(least(trunc(0.75 * w)::INT, w) - x, 1) AS w, greatest(least(trunc(0.9991 * h)::INT, h) - y, 1) AS h FROM c"""
)
def normalized_crop(spark, sf_dir):
    box = geometry.crop_pixels(F.lit(0.25), F.lit(0.999), F.lit(0.75), F.lit(0.9991), F.col("w"), F.col("h"))
    return sizes(spark, sf_dir).select("image", *[v.alias(n) for n, v in zip("xywh", box, strict=True)])
