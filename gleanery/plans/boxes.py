"""Boxes, tiles and detector decoding. ``part`` gives boxes grouped by brand (an image), ``documents`` image sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, image
from ..operators import overlap, suppression
from .registry import query, table
from .similarity import r

BOXES = """b AS (SELECT p_partkey AS id, p_brand AS image, p_partkey % 97 AS x, p_partkey % 89 AS y, 10 + p_size AS w, 10 + p_size % 13 AS h, (p_partkey * 7919 % 1000) / 1000.0 AS score FROM part)"""
IOU = """(greatest(least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x), 0) * greatest(least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y), 0))::DOUBLE"""
IOU = f"({IOU} / (a.w * a.h + c.w * c.h - {IOU}))"


def boxes(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_brand").alias("image"), (k % 97).alias("x"), (k % 89).alias("y"), (10 + F.col("p_size")).alias("w"), (10 + F.col("p_size") % 13).alias("h"),
        ((k * 7919 % 1000) / 1000.0).alias("score"),
    )


@query(f"WITH {BOXES} SELECT a.image, a.id, c.id AS other, round({IOU}, 6) AS iou FROM b a JOIN b c ON a.image = c.image AND a.id < c.id AND {IOU} >= 0.3")
def box_iou_join(spark, sf_dir):
    # rounded as the SQL does, by a product: F.round goes through decimals, which takes longer than the pairs
    rounded = F.floor(F.col("iou") * 1e6 + 0.5) / 1e6
    return overlap.pairs(boxes(spark, sf_dir), 0.3).select("image", "id", F.col("id2").alias("other"), rounded.alias("iou"))


@query(f"WITH {BOXES}, p AS (SELECT a.image, a.id FROM b a JOIN b c ON a.image = c.image AND a.id < c.id AND {IOU} > 0.4) SELECT image, count(*) AS pairs, count(DISTINCT id) AS boxes FROM p GROUP BY image")
def box_duplicates(spark, sf_dir):
    return overlap.counted(boxes(spark, sf_dir), 0.4).groupBy("image").agg(F.sum("n").alias("pairs"), F.count("*").alias("boxes"))


@query(
    f"""WITH RECURSIVE {BOXES}, s AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, id) AS n FROM b),
    k AS (SELECT image, 0::BIGINT AS n, []::STRUCT(id BIGINT, x BIGINT, y BIGINT, w BIGINT, h BIGINT)[] AS kept FROM (SELECT DISTINCT image FROM b)
        UNION ALL SELECT k.image, k.n + 1, CASE WHEN len(list_filter(k.kept, lambda c: {IOU.replace("a.", "s.")} > 0.4)) > 0 THEN k.kept
            ELSE list_append(k.kept, {{'id': s.id, 'x': s.x::BIGINT, 'y': s.y::BIGINT, 'w': s.w::BIGINT, 'h': s.h::BIGINT}}) END
        FROM k JOIN s ON s.image = k.image AND s.n = k.n + 1),
    done AS (SELECT image, unnest(arg_max(kept, n)) AS box FROM k GROUP BY image)
    SELECT image, box.id AS id FROM done"""
)
def nms_hard(spark, sf_dir):
    b = boxes(spark, sf_dir).select("image", "id", "score", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return suppression.hard(b, "image", 0.4).select("image", "id")


@query()
def nms_soft(spark, sf_dir):
    b = boxes(spark, sf_dir).select(
        "image", "id", "score", *[c.cast("double").alias(n) for n, c in (("x1", F.col("x")), ("y1", F.col("y")), ("x2", F.col("x") + F.col("w")), ("y2", F.col("y") + F.col("h")), ("eye_x", F.col("x") + F.col("w") / 2), ("eye_y", F.col("y") + F.col("h") / 3))]
    )
    return suppression.soft(b, "image").select("image", "id", "score")


SIZES = "i AS (SELECT doc_id AS image, (100 + n_chars % 1500)::INT AS w, (100 + doc_id * 7 % 900)::INT AS h FROM documents)"


def sizes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image"), (100 + F.col("n_chars") % 1500).cast("int").alias("w"), (100 + F.col("doc_id") * 7 % 900).cast("int").alias("h"))


@query(
    f"""WITH {SIZES}, t AS (SELECT image, x, y, least(512, w - x) AS w, least(512, h - y) AS h FROM i, unnest(range(0, w, 256)) AS u(x), unnest(range(0, h, 256)) AS v(y))
    SELECT image, row_number() OVER (PARTITION BY image ORDER BY y, x) - 1 AS tile, x::INT AS x, y::INT AS y, w::INT AS w, h::INT AS h FROM t WHERE w >= 10 AND h >= 10"""
)
def patch_tiles(spark, sf_dir):
    return sizes(spark, sf_dir).select("image", F.posexplode(geometry.tiles(F.col("w"), F.col("h"))).alias("tile", "t")).select("image", F.col("tile").cast("long").alias("tile"), "t.*")


SCALES = (0.1, 0.2, 0.3, 0.5, 0.7, 1.0)


@query(
    f"""WITH {SIZES}, s AS (SELECT image, w AS iw, h AS ih, trunc(w * s)::INT AS w, trunc(h * s)::INT AS h FROM i, unnest({list(SCALES)}::DOUBLE[]) AS u(s)),
    p AS (SELECT image, iw, ih, x, y, w, h, 0 AS whole FROM s, unnest(range(0, greatest(iw - w, 0) + 1, greatest(w // 2, 1))) AS a(x), unnest(range(0, greatest(ih - h, 0) + 1, greatest(h // 2, 1))) AS b(y) WHERE w >= 32 AND h >= 32
        UNION ALL SELECT image, w, h, 0, 0, w, h, 1 FROM i),
    n AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY w * h DESC, y, x, whole) AS n FROM p)
    SELECT image, n, x::INT AS x, y::INT AS y, w, h FROM n WHERE n <= greatest(10, least(100, iw * ih // 50000))"""
)
def roi_sliding_windows(spark, sf_dir):
    """Windows of six sizes and the whole image, largest first, as many as the image's size allows."""
    w, h = F.col("w"), F.col("h")
    most = F.greatest(F.lit(10), F.least(F.lit(100), F.floor(w * h / 50000))).cast("int")
    whole = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), w.alias("w"), h.alias("h")))
    # from the largest share to the smallest, so nothing is sorted; the whole image comes after the window that equals it
    first, *rest = [geometry.windows_at(w, h, s, most=most) for s in sorted(SCALES, reverse=True)]
    sorted_ = F.concat(first, whole, *rest)
    out = sizes(spark, sf_dir).select("image", F.posexplode(F.slice(sorted_, F.lit(1), most)).alias("n", "t"))
    return out.select("image", (F.col("n") + 1).cast("long").alias("n"), "t.x", "t.y", "t.w", "t.h")


@query(
    f"""WITH {SIZES}, s AS (SELECT image, w AS iw, h AS ih, trunc(w * s)::INT AS w, trunc(h * s)::INT AS h, s FROM i, unnest([0.8, 0.6, 0.4, 0.2]::DOUBLE[]) AS u(s))
    SELECT image, (iw - w) // 2 AS x, (ih - h) // 2 AS y, w, h FROM s WHERE w * h >= 500 AND w >= 64 AND h >= 64 AND w * h / (iw * ih)::DOUBLE BETWEEN 0.001 AND 0.95
    UNION ALL SELECT image, 0, 0, w, h FROM i"""
)
def roi_selective_closed(spark, sf_dir):
    """Centred boxes of four sizes and the whole image."""
    w, h = F.col("w"), F.col("h")
    rows = [F.struct(F.floor((w - (w * s).cast("int")) / 2).cast("int").alias("x"), F.floor((h - (h * s).cast("int")) / 2).cast("int").alias("y"), (w * s).cast("int").alias("w"), (h * s).cast("int").alias("h")) for s in (0.8, 0.6, 0.4, 0.2)]
    good = lambda t: (t["w"] * t["h"] >= 500) & (t["w"] >= 64) & (t["h"] >= 64) & ((t["w"] * t["h"]) / (w * h)).between(0.001, 0.95)
    every = F.concat(F.filter(F.array(*rows), good), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), w.alias("w"), h.alias("h"))))
    return sizes(spark, sf_dir).select("image", F.explode(every).alias("t")).select("image", "t.*")


@query(
    f"""WITH {SIZES}, l AS (SELECT image, w, h, least(640.0::DOUBLE / w, 640.0::DOUBLE / h) AS scale FROM i), n AS (SELECT *, trunc(w * scale)::INT AS new_w, trunc(h * scale)::INT AS new_h FROM l)
    SELECT image, round(scale, 6) AS scale, new_w, new_h, (640 - new_w) // 2 AS pad_x, (640 - new_h) // 2 AS pad_y, round((320 - (640 - new_w) // 2) / scale, 9) AS centre_x, round((320 - (640 - new_h) // 2) / scale, 9) AS centre_y FROM n"""
)
def letterbox_decode(spark, sf_dir):
    p = geometry.letterbox(F.col("w"), F.col("h"))
    own = sizes(spark, sf_dir).select("image", *[v.alias(k) for k, v in p.items()])
    centre = [r(geometry.unletterbox(F.lit(320), F.col(f"pad_{a}"), F.col("scale")), 9).alias(f"centre_{a}") for a in "xy"]
    return own.select("image", r("scale").alias("scale"), "new_w", "new_h", "pad_x", "pad_y", *centre)


@query(
    """WITH s AS (SELECT l_orderkey AS image, l_linenumber AS det, (l_partkey % 3200)::BIGINT AS i, l_discount * 10 AS p, l_tax * 100 AS d FROM lineitem),
    a AS (SELECT *, i // 2 % 40 * 16 AS cx, i // 2 // 40 * 16 AS cy FROM s)
    SELECT image, det, i, cx, cy, round(cx - d * 16, 6) AS x1, round(cy - d * 16, 6) AS y1, round(cx + d * 16, 6) AS x2, round(cy + d * 16, 6) AS y2 FROM a WHERE p >= 0.3 AND d * 32 >= 16"""
)
def anchor_decode(spark, sf_dir):
    """Scores at stride 16: two anchors a cell, distances in strides; weak and small boxes go."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("det"), (F.col("l_partkey") % 3200).alias("i"), (F.col("l_discount") * 10).alias("p"), (F.col("l_tax") * 100).alias("d"))
    cx, cy = geometry.anchor(F.col("i"), 16)
    own = own.filter((F.col("p") >= 0.3) & (F.col("d") * 32 >= 16)).select("*", cx.alias("cx"), cy.alias("cy"))
    box = geometry.anchor_box(F.col("cx"), F.col("cy"), *[F.col("d")] * 4, 16)
    return own.select("image", "det", "i", "cx", "cy", *[r(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), box, strict=True)])


@query(
    f"""WITH {BOXES}, c AS (SELECT *, greatest(0, least(x, 79)) AS x0, greatest(0, least(y, 69)) AS y0 FROM b)
    SELECT id, x0::BIGINT AS x, y0::BIGINT AS y, greatest(1, least(w, 80 - x0))::BIGINT AS w, greatest(1, least(h, 70 - y0))::BIGINT AS h, trunc(w * (256.0::DOUBLE / greatest(w, h)))::INT AS thumb_w, trunc(h * (256.0::DOUBLE / greatest(w, h)))::INT AS thumb_h FROM c"""
)
def transform_roundtrip(spark, sf_dir):
    """Boxes clamped to an image of 80 x 70, and thumbnail sizes."""
    b = boxes(spark, sf_dir)
    box = geometry.clamp_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(80), F.lit(70))
    tw, th = geometry.resized(F.col("w"), F.col("h"))
    return b.select("id", *[v.cast("long").alias(n) for n, v in zip("xywh", box, strict=True)], tw.alias("thumb_w"), th.alias("thumb_h"))


FACES = """f AS (SELECT l_orderkey AS image, l_linenumber AS face, l_discount * 10 AS det, least(l_quantity, l_partkey % 60) AS w, l_tax * 300 AS eyes, abs(l_tax * 10 - 0.4) AS tilt, l_quantity AS dy FROM lineitem),
g AS (SELECT *, greatest(0.0, least(1.0, w / 150.0)) AS area, ((1 - least(tilt, 1)) + (1 - least(dy / 50.0, 1))) / 2 AS pose FROM f),
q AS (SELECT *, CASE WHEN det < 0.3 THEN 'detector' WHEN area < 0.15 THEN 'area' WHEN eyes < 12 THEN 'eyes' WHEN pose < 0.2 THEN 'pose' END AS reason, det * 0.7 + pose * 0.3 AS quality FROM g)"""


def _faces(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("face"), (F.col("l_discount") * 10).alias("det"), F.least(F.col("l_quantity"), (F.col("l_partkey") % 60).cast("double")).alias("w"),
        (F.col("l_tax") * 300).alias("eyes"), F.abs(F.col("l_tax") * 10 - 0.4).alias("tilt"), F.col("l_quantity").alias("dy"),
    )
    own = own.withColumn("area", image.area_score(F.col("w"), F.col("w"))).withColumn("pose", image.pose_score(F.col("tilt"), F.col("dy")))
    return own.withColumn("reason", image.reject_reason(F.col("det"), F.col("area"), F.col("eyes"), F.col("pose"))).withColumn("quality", image.face_quality(F.col("det"), F.lit(0.0), F.col("pose")))


@query(f"WITH {FACES} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, round(coalesce(avg(quality), 0), 6) AS quality FROM q GROUP BY ALL")
def face_quality_gate(spark, sf_dir):
    return _faces(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), r(F.coalesce(F.avg("quality"), F.lit(0.0))).alias("quality"))


@query(f"WITH {FACES} SELECT image, arg_max(face, w * 1000 - face) AS face, round(max(w), 6) AS w, round(avg(quality), 6) AS quality FROM q WHERE reason IS NULL GROUP BY image")
def largest_face(spark, sf_dir):
    """The largest face that passes the gates, the first of equals; images without one give no row."""
    kept = _faces(spark, sf_dir).filter("reason is null")
    return kept.groupBy("image").agg(F.max_by("face", F.col("w") * 1000 - F.col("face")).alias("face"), r(F.max("w")).alias("w"), r(F.avg("quality")).alias("quality"))
