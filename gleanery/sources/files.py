"""Folders of thumbnails and exports, query images, and ground truth."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def folder_statistics(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """``files`` and ``bytes`` below a folder; the content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(path)
    return files.select("length").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def thumbnail_plan(images: DataFrame, existing: DataFrame) -> DataFrame:
    """What to make: one row per content hash without a thumbnail in ``existing`` (path), and where it goes."""
    wanted = images.filter("hash is not null").groupBy("hash").agg(F.min("path").alias("path")).withColumn("thumbnail_path", text.thumbnail_path(F.col("hash")))
    have = existing.select(F.concat_ws("/", F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1)).alias("thumbnail_path"))
    return wanted.join(have, "thumbnail_path", "left_anti")


def thumbnail_report(made: DataFrame, seconds: Column) -> DataFrame:
    """``total``, ``generated``, ``failed`` and ``speed`` (0 where no time passed) of rows with ``status``."""
    counts = made.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "generated").alias("generated"))
    return counts.select("total", "generated", (F.col("total") - F.col("generated")).alias("failed"), throughput(F.col("generated"), seconds).alias("speed"))


def throughput(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n / seconds).otherwise(0.0)


def crop_error(w: Column, h: Column, x: Column, y: Column, crop_w: Column, crop_h: Column) -> Column:
    """Why a crop is refused, or NULL."""
    return F.when((crop_w <= 0) | (crop_h <= 0), "empty").when((x < 0) | (y < 0) | (x + crop_w > w) | (y + crop_h > h), "outside")


def query_name(media_type: Column, content: Column) -> Column:
    """The name a query image is kept under; NULL for fewer than four bytes."""
    return F.when(F.length(content) >= 4, F.concat(F.lit("query_image."), text.suffix(media_type)))


def export(rows: DataFrame, target: str) -> DataFrame:
    """Copies the files of ``rows`` (path) to a folder that all executors reach; ``path``, ``copied``.

    Files are read and written through the cluster's own file systems, so stores need no mount."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for r in rows.select("path").toLocalIterator():  # a user's selection
        src = jvm.org.apache.hadoop.fs.Path(r.path)
        dst = jvm.org.apache.hadoop.fs.Path(target, src.getName())
        try:
            done = bool(jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, dst.getFileSystem(conf), dst, False, conf))
        except Exception:
            done = False
        out.append((r.path, done))
    if out and not any(done for _, done in out):
        raise OSError("no file could be copied")
    return spark.createDataFrame(out, "path string, copied boolean")


def ground_truth(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """``query``, ``candidate``, ``relevant`` from the plain form of YAML that evaluations use: a query, below it lists."""
    out, query, relevant = [], None, True
    for line in lines:
        s = line.split("#")[0].rstrip()
        if not s:
            continue
        item = s.strip()
        if not s.startswith((" ", "-")):
            query = item.rstrip(":").strip("\"'")
        elif item.startswith("-"):
            out.append((query, item[1:].strip().strip("\"'"), relevant))
        else:
            relevant = item.rstrip(":") != "irrelevant"
    return spark.createDataFrame(out, "query string, candidate string, relevant boolean")
