"""Image statistics over a pixel relation made of ``lineitem``: one image per line number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import image
from ..operators import pairs
from .registry import query, table
from .similarity import r

PIXELS = "p AS (SELECT l_linenumber AS image, (l_partkey % 256)::INT AS r, (l_suppkey * 7 % 256)::INT AS g, (l_orderkey % 256)::INT AS b FROM lineitem)"
HIGH, LOW = "greatest(r, g, b)", "least(r, g, b)"
LIGHT = f"(({HIGH} + {LOW}) / 510.0::DOUBLE)"
SATURATION = f"(CASE WHEN {LIGHT} > 0 AND {LIGHT} < 1 THEN (({HIGH} - {LOW}) / 255.0::DOUBLE) / (1 - abs(2 * {LIGHT} - 1)) END)"
LUMINANCE = "(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE)"
HUE = f"""(CASE WHEN {HIGH} = {LOW} THEN 0 WHEN {HIGH} = r THEN 60 * (((g - b)::DOUBLE / ({HIGH} - {LOW})) % 6) WHEN {HIGH} = g THEN 60 * ((b - r)::DOUBLE / ({HIGH} - {LOW}) + 2) ELSE 60 * ((r - g)::DOUBLE / ({HIGH} - {LOW}) + 4) END)"""
HUE = f"(CASE WHEN {HUE} < 0 THEN {HUE} + 360 ELSE {HUE} END)"


def pixels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("image"), (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") * 7 % 256).cast("int").alias("g"), (F.col("l_orderkey") % 256).cast("int").alias("b")
    )




def rgb():
    return F.col("r"), F.col("g"), F.col("b")


@query(f"WITH {PIXELS}, c AS (SELECT image, r, g, b, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT image, n / sum(n) OVER (PARTITION BY image) AS q FROM c) SELECT image, round(-sum(q * log2(q)), 6) AS entropy, count(*) AS colors FROM s GROUP BY image")
def color_entropy(spark, sf_dir):
    """From two sums per image, -sum(n/N log n/N) = log N - sum(n log n) / N: no window over the colours."""
    c = pixels(spark, sf_dir).groupBy("image", image.packed(*rgb()).alias("color")).agg(F.count("*").alias("n"))
    s = c.groupBy("image").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("x"), F.count("*").alias("colors"))
    return s.select("image", r(F.log2("total") - F.col("x") / F.col("total")).alias("entropy"), "colors")


@query(
    f"""WITH {PIXELS}, h AS (SELECT image, floor({HUE} / 45)::INT % 8 * 8 + floor((CASE WHEN {HIGH} = 0 THEN 0 ELSE ({HIGH} - {LOW})::DOUBLE / {HIGH} END) * 4)::INT % 4 * 2 + ({HIGH} / 255.0 > 0.5)::INT AS bin FROM p),
    c AS (SELECT image, bin, count(*) AS n FROM h GROUP BY ALL) SELECT image, bin, round(n / sum(n) OVER (PARTITION BY image), 6) AS share FROM c"""
)
def hsv_hist(spark, sf_dir):
    c = pixels(spark, sf_dir).groupBy("image", image.hsv_bin(*rgb()).alias("bin")).agg(F.count("*").alias("n"))
    return c.select("image", "bin", r(F.col("n") / F.sum("n").over(Window.partitionBy("image"))).alias("share"))


CHANNELS = """c AS (SELECT image, 0 AS channel, r // 8 AS bin FROM p UNION ALL SELECT image, 1, g // 8 FROM p UNION ALL SELECT image, 2, b // 8 FROM p),
n AS (SELECT image, channel, bin, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT image, count(*) AS total FROM p GROUP BY image)"""


def _rgb_hist(spark, sf_dir) -> DataFrame:
    own = pixels(spark, sf_dir)
    each = own.select("image", F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), F.shiftright(c, 3).alias("bin")) for k, c in enumerate("rgb")])).alias("x"))
    n = each.groupBy("image", "x.channel", "x.bin").agg(F.count("*").alias("n"))
    # three bins a pixel, so a third of the rows are its image's pixels
    return n.withColumn("share", F.col("n") * 3 / F.sum("n").over(Window.partitionBy("image")))


@query(f"WITH {PIXELS}, {CHANNELS} SELECT image, channel, bin, round(n / total, 6) AS share FROM n JOIN t USING (image)")
def rgb_hist(spark, sf_dir):
    return _rgb_hist(spark, sf_dir).select("image", "channel", "bin", r("share").alias("share"))


@query(
    f"""WITH {PIXELS}, {CHANNELS}, h AS (SELECT image, channel, bin, n / total AS share FROM n JOIN t USING (image))
    SELECT a.image, b.image AS other, round(sum(least(a.share, b.share)), 6) AS shared FROM h a JOIN h b ON a.channel = b.channel AND a.bin = b.bin AND a.image < b.image GROUP BY ALL"""
)
def hist_intersection(spark, sf_dir):
    """Dense histograms of 96 bins, one row an image, compared as arrays, for a choice of images whose number is checked."""
    dense = F.transform(F.sequence(F.lit(0), F.lit(95)), lambda k: F.coalesce(F.try_element_at(F.col("h"), k), F.lit(0.0)))
    h = _rgb_hist(spark, sf_dir).groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct((F.col("channel") * 32 + F.col("bin")).alias("k"), "share"))).alias("h"))
    both = pairs.of_chosen(h.select("image", dense.alias("h")), "image")
    return both.select("image", F.col("image2").alias("other"), r(image.intersection(F.col("h"), F.col("h2"))).alias("shared"))


@query(f"WITH {PIXELS} SELECT image, round(avg({SATURATION}), 6) AS saturation, avg((r > g AND r > 95 AND abs(r - g) < 50 AND abs(g - b) < 50 AND {HUE} > 0 AND {HUE} < 50 AND coalesce({SATURATION}, 0) > 0.1)::INT)::DECIMAL(18, 6)::DOUBLE AS skin FROM p GROUP BY image")
def saturation(spark, sf_dir):
    own = pixels(spark, sf_dir)
    return own.groupBy("image").agg(r(F.avg(image.hsl_saturation(*rgb()))).alias("saturation"), r(F.avg(image.skin(*rgb()).cast("int"))).alias("skin"))


@query(f"WITH {PIXELS} SELECT image, round(avg({LUMINANCE}), 6) AS mean, round(var_pop({LUMINANCE}), 4) AS variance, round(max({LUMINANCE}) - min({LUMINANCE}), 6) AS spread, round(avg(({LUMINANCE} > 10)::INT), 6) AS coverage FROM p GROUP BY image")
def brightness(spark, sf_dir):
    lum = image.luminance(*rgb())
    return pixels(spark, sf_dir).groupBy("image").agg(r(F.avg(lum)).alias("mean"), r(F.var_pop(lum), 4).alias("variance"), r(F.max(lum) - F.min(lum)).alias("spread"), r(F.avg((lum > 10).cast("int"))).alias("coverage"))


@query(
    f"""WITH {PIXELS}, c AS (SELECT image, r, g, b, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT image, n / sum(n) OVER (PARTITION BY image) AS q FROM c), e AS (SELECT image, -sum(q * log2(q)) AS entropy FROM s GROUP BY image),
    m AS (SELECT image, avg({SATURATION}) AS saturation, count(DISTINCT (r // 16) * 65536 + (g // 16) * 256 + b // 16) AS colors, var_pop({LUMINANCE}) AS variance, 200 + image * 100 AS w, 300 AS h FROM p GROUP BY image)
    SELECT image, colors, CASE WHEN least(w, h) < 256 THEN 'unknown' WHEN greatest(w, h) / least(w, h) > 2.5 THEN 'screenshot' WHEN entropy < 4 THEN 'anime' WHEN saturation > 0.65 THEN 'poster' WHEN colors < 100 THEN 'meme' WHEN variance < 0.01 AND w <> h THEN 'screenshot' ELSE 'photo' END AS kind
    FROM m JOIN e USING (image)"""
)
def image_type(spark, sf_dir):
    entropy = color_entropy(spark, sf_dir).select("image", "entropy")
    own = pixels(spark, sf_dir).groupBy("image").agg(F.avg(image.hsl_saturation(*rgb())).alias("saturation"), F.count_distinct(image.packed(*rgb(), 4)).alias("colors"), F.var_pop(image.luminance(*rgb())).alias("variance"))
    own = own.join(entropy, "image")
    return own.select("image", "colors", image.image_type(200 + F.col("image") * 100, F.lit(300), F.col("entropy"), F.col("saturation"), F.col("colors"), F.col("variance")).alias("kind"))


@query(
    f"""WITH {PIXELS}, h AS (SELECT image, floor({LUMINANCE} + 1e-9)::INT AS level, count(*) AS n FROM p GROUP BY ALL),
    c AS (SELECT image, level, n, sum(n) OVER (PARTITION BY image ORDER BY level) AS cdf, sum(n) OVER (PARTITION BY image) AS total FROM h), m AS (SELECT *, min(cdf) OVER (PARTITION BY image) AS least FROM c)
    SELECT image, level, cdf::BIGINT AS cdf, round((cdf - least)::DOUBLE / (total - least) * 255)::INT AS lut FROM m"""
)
def equalize_lut(spark, sf_dir):
    level = F.floor(image.luminance(*rgb()) + 1e-9).cast("int")
    h = pixels(spark, sf_dir).groupBy("image", level.alias("level")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("image")
    h = h.withColumn("cdf", F.sum("n").over(w.orderBy("level").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    h = h.withColumn("least", F.min("cdf").over(w))
    return h.select("image", "level", "cdf", F.round((F.col("cdf") - F.col("least")) / (F.col("total") - F.col("least")) * 255).cast("int").alias("lut"))


@query(
    f"""WITH {PIXELS}, i AS (SELECT image, (row_number() OVER (PARTITION BY image ORDER BY r, g, b) - 1) AS n, {LUMINANCE} AS lum FROM p), g AS (SELECT image, n // 64 AS y, n % 64 AS x, lum FROM i),
    s AS (SELECT image, lag(lum) OVER a + lead(lum) OVER a + lag(lum) OVER b + lead(lum) OVER b - 4 * lum AS laplacian, lead(lum) OVER a - lum AS gradient FROM g WINDOW a AS (PARTITION BY image, y ORDER BY x), b AS (PARTITION BY image, x ORDER BY y))
    SELECT image, count(laplacian) AS inner_pixels, round(var_pop(laplacian), 4) AS variance, round(avg((abs(gradient) > 20)::INT), 6) AS edges FROM s GROUP BY image"""
)
def laplacian_variance(spark, sf_dir):
    """Pixels laid out 64 to a row; a stencil of the four neighbours."""
    lum = image.luminance(*rgb())
    own = pixels(spark, sf_dir).withColumn("at", F.row_number().over(Window.partitionBy("image").orderBy("r", "g", "b")) - 1)
    own = own.select("image", F.floor(F.col("at") / 64).alias("y"), (F.col("at") % 64).alias("x"), lum.alias("lum"))
    a, b = Window.partitionBy("image", "y").orderBy("x"), Window.partitionBy("image", "x").orderBy("y")
    around = F.lag("lum").over(a) + F.lead("lum").over(a) + F.lag("lum").over(b) + F.lead("lum").over(b) - 4 * F.col("lum")
    s = own.select("image", around.alias("laplacian"), (F.lead("lum").over(a) - F.col("lum")).alias("gradient"))
    return s.groupBy("image").agg(F.count("laplacian").alias("inner_pixels"), r(F.var_pop("laplacian"), 4).alias("variance"), r(F.avg((F.abs("gradient") > 20).cast("int"))).alias("edges"))
