"""The smaller functions over whole tables: codecs, cosine variants, gates, alignment, names, look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, image, keypoints, text, vector
from ..operators import evaluation
from ..sources import vectors as stores
from .registry import query, table
from .similarity import r, vectors


@query(
    """WITH f AS (SELECT label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS v FROM embeddings GROUP BY label),
    s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, f.v, list_cosine_similarity(CAST(embedding AS DOUBLE[]), f.v) AS c FROM embeddings JOIN f USING (label))
    SELECT vec_id, round(c, 6) + 0 AS cosine, round(greatest(-1, least(1, c)), 6) + 0 AS clamped, round(c, 6) + 0 AS of_units, round(list_inner_product(e, v), 6) + 0 AS dot, round(list_distance(e, v) ** 2, 6) + 0 AS squared, 0.0::DOUBLE AS with_zero FROM s"""
)
def cosine_variants(spark, sf_dir):
    """Every vector against its label's first one, by each definition."""
    v = vectors(spark, sf_dir)
    f = v.groupBy("label").agg(F.min_by("vector", "id").alias("first"))
    a, b = F.col("vector"), F.col("first")
    forms = {
        "cosine": vector.cosine(a, b), "clamped": vector.cosine_clamped(a, b), "of_units": vector.dot(vector.normalized(a), vector.normalized(b)),
        "dot": vector.dot(a, b), "squared": vector.squared_distance(a, b), "with_zero": vector.cosine(a, F.transform(b, lambda x: x * 0)),
    }
    return v.join(f, "label").select(F.col("id").alias("vec_id"), *[(r(c) + 0.0).alias(n) for n, c in forms.items()])


@query(
    """SELECT vec_id, 4 * len(embedding) AS bytes, round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0 AS total, len(embedding) AS tolerant_size, true AS refused FROM embeddings"""
)
def vector_codec(spark, sf_dir):
    """Vectors to 32-bit blobs and back; a blob with a byte too many is refused, or cut where that is allowed."""
    coded = stores.encode(vectors(spark, sf_dir))
    longer = stores.decode(coded.withColumn("blob", F.concat("blob", F.lit(b"\0"))), tolerant=True).withColumnRenamed("vector", "cut")
    strict = stores.decode(longer).withColumnRenamed("vector", "whole")
    back = stores.decode(strict.withColumn("own", F.expr("substring(blob, 1, octet_length(blob) - 1)")), "own")
    return back.select(
        F.col("id").alias("vec_id"), F.octet_length("own").cast("long").alias("bytes"), (r(vector.total(F.col("vector"))) + 0.0).alias("total"),
        F.size("cut").cast("long").alias("tolerant_size"), F.col("whole").isNull().alias("refused"),
    )


@query(
    """WITH p AS (SELECT p_partkey AS id, 1 + p_size / 50.0::DOUBLE AS a, (p_partkey % 7 - 3) / 10.0::DOUBLE AS b, (p_partkey % 97)::DOUBLE AS tx, (p_partkey % 89)::DOUBLE AS ty FROM part)
    SELECT id, round(a / (a * a + b * b), 6) + 0 AS a, round(-b / (a * a + b * b), 6) + 0 AS b, round(-(a * tx + b * ty) / (a * a + b * b), 6) + 0 AS tx, round((b * tx - a * ty) / (a * a + b * b), 6) + 0 AS ty FROM p"""
)
def align_transform(spark, sf_dir):
    """The landmarks turned, scaled and shifted by known values: the transform back to them must undo those."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("id"), (1 + F.col("p_size") / 50.0).alias("a"), ((k % 7 - 3) / 10.0).alias("b"), (k % 97).cast("double").alias("tx"), (k % 89).cast("double").alias("ty"))
    a, b, tx, ty = (F.col(c) for c in ("a", "b", "tx", "ty"))
    goal = keypoints.landmarks()
    found = geometry.similarity_transform([(a * x - b * y + tx, b * x + a * y + ty) for x, y in goal], goal)
    return p.select("id", *[(r(c) + 0.0).alias(n) for n, c in found.items()])


@query(
    """WITH b AS (SELECT p_partkey AS id, (p_partkey % 97)::DOUBLE AS x, (p_partkey % 89)::DOUBLE AS y, (10 + p_size)::DOUBLE AS w, p_partkey * 7919 % 1000 / 1000.0::DOUBLE AS score, (p_partkey % 211)::DOUBLE AS ex, (p_partkey % 223)::DOUBLE AS ey FROM part)
    SELECT id, round(CASE WHEN ex BETWEEN x - 50 AND x + w + 50 AND ey BETWEEN y - 50 AND y + w + 50 THEN score ELSE score * 0.7 END, 6) AS score, round(sqrt((ex - x) ** 2 + (ey - y) ** 2), 6) AS far,
           round((ex + 3) * w, 6) AS shifted_x, round((ey - 2) * w, 6) AS shifted_y FROM b"""
)
def eye_scores(spark, sf_dir):
    """Scores of boxes with an eye far outside are lowered; distances, and keypoints shifted and scaled."""
    k = F.col("p_partkey")
    d = {"x": k % 97, "y": k % 89, "w": 10 + F.col("p_size"), "ex": k % 211, "ey": k % 223}
    b = table(spark, sf_dir, "part").select(k.alias("id"), ((k * 7919 % 1000) / 1000.0).alias("score"), *[c.cast("double").alias(n) for n, c in d.items()])
    x, y, w, ex, ey = (F.col(c) for c in ("x", "y", "w", "ex", "ey"))
    moved = keypoints.shifted(F.array(ex, ey), F.lit(3.0), F.lit(-2.0), w)
    return b.select(
        "id", r(geometry.eye_score(F.col("score"), x, y, x + w, y + w, [(ex, ey)])).alias("score"), r(geometry.eye_distance(ex, ey, x, y)).alias("far"),
        r(moved[0]).alias("shifted_x"), r(moved[1]).alias("shifted_y"),
    )


@query(
    """WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, l_quantity AS q, l_discount * 10 AS det, l_tax * 1000 AS angle, l_partkey % 300 AS variance, (l_suppkey * 37 % 1000)::DOUBLE AS w, (l_partkey * 13 % 700)::DOUBLE AS h FROM lineitem),
    s AS (SELECT *, greatest(0.0, least(1.0, variance / 100.0::DOUBLE)) AS blur, greatest(abs(angle) - 15, 0) / 45 AS off FROM l),
    f AS (SELECT *, greatest(0.0, least(1.0, det * 0.30 + blur * 0.25 + least(q * 400 / 10000.0, 1.0) * 0.25 + (1 - off) * 0.20)) AS quality FROM s)
    SELECT id, n, round(blur, 6) AS blur, round(quality, 6) AS quality,
        CASE WHEN least(w, h) < 256 THEN 'small' WHEN greatest(w, h) / least(w, h) > 5 THEN 'aspect' WHEN q * 5000 / (w * h) < 0.05 THEN 'bytes' WHEN det < 3.5 THEN 'entropy' END AS skipped,
        CASE WHEN (q > 40)::INT + (det < 0.2)::INT + (variance < 50)::INT >= 2 OR round(quality, 9) < 0.3 THEN 'fake' WHEN round(quality, 9) > 0.6 THEN 'real' ELSE 'unsure' END AS verdict,
        CASE WHEN det < CASE WHEN q > 10 THEN 0.3 ELSE 0.45 END THEN 'detector' WHEN blur < 0.15 THEN 'area' WHEN q < 12 THEN 'eyes' WHEN 1 - off < 0.2 THEN 'pose' END AS query_side
    FROM f"""
)
def face_gates(spark, sf_dir):
    """Quality by angles, the skip filter of images, the vote on real faces, and the stricter gate on the query's side."""
    own = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), (F.col("l_discount") * 10).alias("det"), (F.col("l_tax") * 1000).alias("angle"),
        (F.col("l_partkey") % 300).alias("variance"), (F.col("l_suppkey") * 37 % 1000).cast("double").alias("w"), (F.col("l_partkey") * 13 % 700).cast("double").alias("h"),
    )
    q, det, angle, variance = (F.col(c) for c in ("q", "det", "angle", "variance"))
    own = own.withColumn("blur", image.blur_score(variance))
    own = own.withColumn("quality", image.face_quality_angles(det, F.col("blur"), q * 400, angle, angle, angle))
    pose = 1 - F.greatest(F.abs(angle) - 15, F.lit(0.0)) / 45
    return own.select(
        "id", "n", r("blur").alias("blur"), r("quality").alias("quality"), image.passes_filter(F.col("w"), F.col("h"), q * 5000, det).alias("skipped"),
        image.real_face([q > 40, det < 0.2, variance < 50], F.round("quality", 9)).alias("verdict"), image.reject_reason(det, F.col("blur"), q, pose, q > 10).alias("query_side"),
    )


CATALOG = "c AS (SELECT doc_id AS id, source AS folder, sha256(coalesce(text, '')) AS hash, n_chars AS size FROM documents)"


def _catalog(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("folder"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.col("n_chars").alias("size"))


@query(f"WITH {CATALOG} SELECT q.id AS query_id, count(*) AS same_hash, min(c.id) AS first_id, count(*) > 1 AS copied FROM c q JOIN c ON q.hash = c.hash WHERE q.id % 20 = 0 GROUP BY q.id")
def images_by_hash(spark, sf_dir):
    """Look-ups by content hash: folded per hash first, so that a content held by a third of all files is one row."""
    c = _catalog(spark, sf_dir)
    per_hash = c.groupBy("hash").agg(F.count("*").alias("same_hash"), F.min("id").alias("first_id"))
    return c.filter("id % 20 = 0").join(per_hash, "hash").select(F.col("id").alias("query_id"), "same_hash", "first_id", (F.col("same_hash") > 1).alias("copied"))


@query(f"WITH {CATALOG} SELECT folder, count(*) AS images, count(DISTINCT hash) AS contents, min(id) AS first_id, max(size) AS largest FROM c GROUP BY folder")
def images_by_folder(spark, sf_dir):
    return _catalog(spark, sf_dir).groupBy("folder").agg(F.count("*").alias("images"), F.count_distinct("hash").alias("contents"), F.min("id").alias("first_id"), F.max("size").alias("largest"))


@query(
    """WITH p AS (SELECT p_brand AS image, count(*) AS raw, count(*) FILTER (p_size > 10) AS kept, count(*) FILTER (p_size > 12) AS theirs FROM part GROUP BY p_brand)
    SELECT image, raw, kept, round(CASE WHEN raw = 0 THEN 0 ELSE (raw - kept) / raw::DOUBLE * 100 END, 6) AS reduction, CASE WHEN theirs = 0 THEN kept = 0 ELSE abs(kept - theirs) / theirs::DOUBLE <= 0.1 END AS agree FROM p"""
)
def detector_counts(spark, sf_dir):
    """Per image: boxes before and after a filter, the share removed, and whether two detectors' counts agree to a tenth."""
    p = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("image")).agg(F.count("*").alias("raw"), *[F.count(F.when(F.col("p_size") > n, 1)).alias(c) for c, n in (("kept", 10), ("theirs", 12))])
    return p.select("image", "raw", "kept", r(evaluation.reduction(F.col("raw"), F.col("kept"))).alias("reduction"), evaluation.counts_agree(F.col("kept"), F.col("theirs"), 0.1).alias("agree"))


@query(
    """SELECT p_partkey AS id, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 5) || '...' ELSE p_name END AS short_name, rtrim(substr(rpad(p_type, 12, ' '), 1, 12), ' ') AS fixed_type, length(p_type) > 12 AS was_cut FROM part"""
)
def fixed_names(spark, sf_dir):
    """Names shortened for display, and types padded with NUL characters to a fixed size and read back."""
    p = table(spark, sf_dir, "part")
    name = text.shortened(F.col("p_name"), 8)
    return p.select(F.col("p_partkey").alias("id"), name.alias("short_name"), F.rtrim(text.unfixed(text.fixed(F.col("p_type"), 12))).alias("fixed_type"), (F.char_length("p_type") > 12).alias("was_cut"))


@query(
    """WITH f AS (SELECT label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS v FROM embeddings GROUP BY label),
    s AS (SELECT vec_id, vec_id % 40 AS n, label * 3 AS m, list_inner_product(CAST(embedding AS DOUBLE[]), f.v) AS c FROM embeddings JOIN f USING (label))
    SELECT vec_id, CASE WHEN abs(n - m) > 15 THEN true ELSE round(c, 9) < 0.2 END AS skipped FROM s"""
)
def early_exits(spark, sf_dir):
    """Pairs to skip before matching: counts too far apart, or mean descriptors too unlike."""
    v = vectors(spark, sf_dir)
    f = v.groupBy("label").agg(F.min_by("vector", "id").alias("first"))
    skip = vector.early_exit(F.col("id") % 40, F.col("vector"), F.col("label") * 3, F.col("first"), 15, 0.2)
    return v.join(f, "label").select(F.col("id").alias("vec_id"), skip.alias("skipped"))
