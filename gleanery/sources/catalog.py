"""The catalog of image files: scanning folders, incremental classification, and its tables' changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


def scan_folder(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """Image files below ``path``: path, size, modified_time (seconds), and the content's hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.filter(text.is_image(F.col("path")))
    out = files.select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified_time"), *([F.sha2("content", 256).alias("hash")] if with_content else []))
    return out


def classify(files: DataFrame, images: DataFrame) -> DataFrame:
    """Each file's ``state`` against the catalog: unchanged (path, size and time known), duplicate (content known under another path), changed (path known) or new."""
    known = images.select("path", F.col("size").alias("c_size"), F.col("modified_time").alias("c_time"), F.lit(True).alias("at_path"))
    known = known.dropDuplicates(["path"])
    hashes = images.select("hash").distinct().withColumn("has_hash", F.lit(True))
    both = files.join(known, "path", "left").join(hashes, "hash", "left")
    same = F.col("at_path") & (F.col("size") == F.col("c_size")) & (F.col("modified_time") == F.col("c_time"))
    state = F.when(same, "unchanged").when(F.col("at_path"), "changed").when(F.col("has_hash"), "duplicate").otherwise("new")
    return both.select(*files.columns, state.alias("state"))


def merge_scan(images: DataFrame, classified: DataFrame) -> DataFrame:
    """The catalog after a scan: changed rows take the file's values and become pending, new paths are added."""
    changed = classified.filter("state = 'changed'").select("path", *[F.col(c).alias(f"n_{c}") for c in ("hash", "size", "modified_time")], F.lit(True).alias("is_changed"))
    updated = images.join(changed, "path", "left").select(
        "id",
        "path",
        *[F.coalesce(f"n_{c}", c).alias(c) for c in ("hash", "size", "modified_time")],
        F.when(F.col("is_changed"), "pending").otherwise(F.col("scan_status")).alias("scan_status"),
    )
    added = classified.filter("state in ('new', 'duplicate')").dropDuplicates(["path"]).join(images.select("path"), "path", "left_anti")
    return updated.unionByName(with_ids(added.select("path", "hash", "size", "modified_time", F.lit("pending").alias("scan_status")), images, "path"))


def with_ids(rows: DataFrame, table: DataFrame, order: str) -> DataFrame:
    """``id`` after the table's largest, in the order of ``order`` (null first): a rank by ranges, without one task for all rows.

    The ranges' bounds are drawn once and are constants of the plan, as the rows are counted in one run and numbered in
    another: which physical partition holds a row may differ between the two (its columns and adaptive planning decide)."""
    spark = rows.sparkSession
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = sorted(r[0] for r in rows.select(order).filter(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(20 * n).collect())
    bounds = sorted({drawn[i * len(drawn) // n] for i in range(1, n)}) if drawn else []
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    ranged = rows.withColumn("_part", part)
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one number a range
    before, starts = last, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    starts = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.withColumn("_own", own).join(starts, "_part").select((F.col("_start") + F.col("_own")).cast("long").alias("id"), *rows.columns)


def enqueue(images: DataFrame, classified: DataFrame, tasks: DataFrame) -> DataFrame:
    """New image tasks: one for each pending image of the scanned paths that has none pending."""
    waiting = tasks.filter("task_type = 'image' and status = 'pending'").select(F.col("image_id").alias("id"))
    pending = images.filter("scan_status = 'pending'").join(classified.select("path").distinct(), "path", "left_semi").join(waiting, "id", "left_anti")
    return pending.select(F.col("id").alias("image_id"), F.lit("image").alias("task_type"), F.lit("pending").alias("status"), F.lit(0).alias("retry_count"))


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str, *ties: str) -> DataFrame:
    """``rows`` replace those of their keys; of several for a key the last by ``order`` wins, of equal ones the first by ``ties``."""
    w = Window.partitionBy(key).orderBy(F.desc(order), *ties)
    last = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", order, *ties)
    return table.join(last.select(key), key, "left_anti").unionByName(last.select(*table.columns))


def set_where(table: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` takes the value in ``changes`` (key, value) where there is one."""
    own = changes.select(key, F.col("value").alias("_value"), F.lit(True).alias("_set"))
    return table.join(own, key, "left").select(*[F.when(F.col("_set"), F.col("_value")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in table.columns])


def add_where(table: DataFrame, deltas: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` grows by the sum of the key's ``delta``."""
    own = deltas.groupBy(key).agg(F.sum("delta").alias("_delta"))
    return table.join(own, key, "left").select(*[(F.col(c) + F.coalesce("_delta", F.lit(0))).alias(c) if c == column else F.col(c) for c in table.columns])


def delete_where(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def duplicates(images: DataFrame) -> DataFrame:
    return images.groupBy("hash").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).filter("copies > 1")


def page(table: DataFrame, number: int, size: int = 20, order: str = "id") -> DataFrame:
    return table.orderBy(order).offset((number - 1) * size).limit(size)


def library(images: DataFrame, most: int = 200) -> DataFrame:
    """The first rows, then those of them that have a thumbnail: in this order."""
    return images.orderBy("id").limit(most).filter("thumbnail_path is not null")


def results(found: DataFrame, images: DataFrame) -> DataFrame:
    """Search results (image_id, path, score) with the thumbnail, or the path where there is none, and the file's name."""
    own = images.select(F.col("id").alias("image_id"), "thumbnail_path")
    return found.join(own, "image_id", "left").select(
        "image_id", "score", F.coalesce("thumbnail_path", "path").alias("shown"), text.file_name(F.coalesce("path", F.lit(""))).alias("name"), F.col("thumbnail_path").isNotNull().alias("has_thumbnail")
    )


def statistics(images: DataFrame, faces: DataFrame, persons: DataFrame, objects: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row of counts; each is a map-side count joined as one row."""
    one = images.agg(F.count("*").alias("images"), F.count_if(F.col("thumbnail_status") == "generated").alias("thumbnails"))
    for name, t, cond in (("faces", faces, None), ("persons", persons, None), ("objects", objects, None), ("pending", tasks, F.col("status") == "pending")):
        one = one.join(F.broadcast(t.agg((F.count("*") if cond is None else F.count_if(cond)).alias(name))))
    return one


def scan_status(scanning: bool, scanned: Column, images: Column, pending: Column) -> Column:
    return F.when(F.lit(scanning), scanned).when(pending > 0, F.greatest(images - pending, F.lit(0))).otherwise(images)


def migrate(table: DataFrame, column: str, kind: str, default) -> DataFrame:
    """Adds a column that older files lack, or fills its gaps."""
    have = F.col(column) if column in table.columns else F.lit(None)
    return table.withColumn(column, F.coalesce(have.cast(kind), F.lit(default).cast(kind)))


def rekey(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows take the ``new_id`` of their ``id`` where ``ids`` has one."""
    return table.join(ids, "id", "left").withColumn("id", F.coalesce("new_id", "id")).drop("new_id").select(*table.columns)


def replace_children(table: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents in ``rows`` give way to these."""
    return table.join(rows.select(parent).distinct(), parent, "left_anti").unionByName(rows.select(*table.columns))
