"""The engine: a library's tables and the queries over them. Every method takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vector
from .operators import clustering, evaluation, fine, knn, ranking, suppression
from .sources import catalog, vectors
from .streaming import queue

TABLES = {
    "images": "id long, path string, hash string, size long, modified_time long, scan_status string, thumbnail_path string, thumbnail_status string",
    "tasks": "id long, image_id long, task_type string, status string, retry_count int",
    "faces": "id long, image_id long, person_id long, vector array<float>, quality double, storage_status string",
    "objects": "id long, image_id long, class_name string, confidence float, vector array<float>",
    "patches": "id long, image_id long, patch_index int, num_keypoints int, x float, y float, w float, h float, vector array<float>",
}


class Engine:
    """Tables are Parquet folders below ``warehouse``; one that was never written is empty."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.warehouse = spark, warehouse

    def _path(self, name: str):
        """A path below the warehouse and its file system, as the cluster sees them."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.warehouse}/{name}")
        return path, path.getFileSystem(sc._jsc.hadoopConfiguration())

    def table(self, name: str) -> DataFrame:
        self._settle(name)
        return vectors.read_or_empty(self.spark, f"{self.warehouse}/{name}", TABLES[name])

    def _settle(self, name: str) -> None:
        """Ends a ``replace`` that was cut off after the new table was whole and the old one gone."""
        (live, fs), (new, _), (whole, _) = (self._path(n) for n in (name, f".{name}", f".{name}/_SUCCESS"))
        if not fs.exists(live) and fs.exists(whole):
            fs.rename(new, live)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.mode("append").parquet(f"{self.warehouse}/{name}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Written beside the old table, which may be what ``rows`` reads, and renamed once it is whole."""
        rows.write.mode("overwrite").parquet(f"{self.warehouse}/.{name}")
        live, fs = self._path(name)
        fs.delete(live, True)
        self._settle(name)

    def clear(self) -> None:
        for name, schema in TABLES.items():
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.warehouse}/{name}")

    def scan(self, path: str) -> DataFrame:
        """Scans a folder into the catalog and queues what is pending; gives the files with their state.

        The state is written once: files are not hashed again for each use, and the catalog it was found by is replaced below."""
        images = self.table("images")
        catalog.classify(catalog.scan_folder(self.spark, path), images).write.mode("overwrite").parquet(f"{self.warehouse}/.found")
        found = self.spark.read.parquet(f"{self.warehouse}/.found")
        core = ("id", "path", "hash", "size", "modified_time", "scan_status")
        merged = catalog.merge_scan(images.select(*core), found).join(images.select("id", "thumbnail_path", "thumbnail_status"), "id", "left")
        self.replace("images", merged.select(*core, "thumbnail_path", F.coalesce("thumbnail_status", F.lit("pending")).alias("thumbnail_status")))
        tasks = self.table("tasks")
        new = catalog.enqueue(self.table("images"), found, tasks)
        if not new.isEmpty():
            self.append("tasks", catalog.with_ids(new, tasks, "image_id"))
        return found

    def process(self, most: int = 100) -> DataFrame:
        """Takes the next tasks, and writes back what became of them."""
        tasks = self.table("tasks")
        path = f"{self.warehouse}/.outcomes"
        queue.outcomes(queue.pending(tasks, most), self.table("images")).write.mode("overwrite").parquet(path)
        done = self.spark.read.parquet(path)
        changed = catalog.set_where(tasks, done.select("id", F.col("status").alias("value")), "id", "status")
        changed = catalog.set_where(changed, done.select("id", F.col("retry_count").alias("value")), "id", "retry_count")
        self.replace("tasks", changed)
        return done

    def search_person(self, query: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Images by their best face; faces without a row and images without one are left out."""
        faces = self.table("faces")
        found = knn.search(faces.filter("storage_status = 'stored'"), query, least=threshold)
        best = knn.best_per_group(found.join(faces.select("id", "image_id"), "id"), "image_id")
        return best.join(self.table("images").select(F.col("id").alias("image_id"), "path"), "image_id").orderBy("query_id", F.desc("score"), "image_id")

    def search_person_image(self, faces: DataFrame, threshold: float = 0.5) -> DataFrame:
        """From the faces found in query images (columns as ``fine.query_face`` has them, ``image`` and ``vector``): by the largest that passes the gates."""
        return self.search_person(fine.query_face(faces, "image").select(F.col("image").alias("id"), "vector"), threshold)

    def search_objects(self, query: DataFrame, k: int = 20) -> DataFrame:
        """Coarse stage: the best images by their best object, over-fetched threefold."""
        objects = self.table("objects")
        found = knn.search(objects, query, k=3 * 2 * k).join(objects.select("id", "image_id"), "id")
        return ranking.coarse_objects(found, "image_id", 2 * k)

    def rank_objects(self, coarse: DataFrame, matched: DataFrame, k: int = 20, least: float = 0.5) -> DataFrame:
        """Fine stage: ``coarse`` as ``search_objects`` gives it, with ``overlap`` of the query's box and the object's; ``matched`` as for ``fine.objects``.

        Images without a row are left out."""
        images = self.table("images").select(F.col("id").alias("image_id"), "path")
        return fine.objects(coarse.join(images, "image_id"), matched, k, least=least)

    def search_patches(self, query: DataFrame, k: int = 50) -> DataFrame:
        """Coarse stage, by the 50 richest patches of each ``query_image``; ``query`` has the columns of ``patches`` besides."""
        patches, rich = self.table("patches"), fine.richest(query, "query_image")
        found = knn.search(patches, rich, k=k).join(patches.select("id", "image_id"), "id").join(rich.select(F.col("id").alias("query_id"), "query_image"), "query_id")
        votes = ranking.coarse_patches(found, "image_id", "query_image")
        return ranking.first_per_key(votes, "query_image", F.desc("votes"), "image_id", most=k)

    def patch_pairs(self, query: DataFrame, coarse: DataFrame) -> DataFrame:
        """What a matcher is to compare: patches of the query and of the coarse stage's images that lie alike."""
        return fine.patch_pairs(query, coarse, self.table("patches"))

    def rank_patches(self, pairs: DataFrame, matched: DataFrame, query: DataFrame, k: int = 20) -> DataFrame:
        """Fine stage: ``matched`` as for ``fine.patches``. Images without a row have an empty path."""
        images = self.table("images").select(F.col("id").alias("image_id"), "path")
        return fine.patches(pairs, matched, query, k).join(images, "image_id", "left").fillna("", ["path"])

    def search_category(self, examples: DataFrame, threshold: float = 0.7, k: int = 50) -> DataFrame:
        """By the prototype of some examples (``id``, ``vector``); NULL classes are named unknown."""
        p = vector.prototypes(examples.withColumn("id", F.lit(0).cast("long")), "id", "vector").select("id", F.col("prototype").alias("vector"))
        objects = self.table("objects")
        found = knn.search(objects, p, k=k, least=threshold)
        return found.join(objects.select("id", "image_id", F.coalesce("class_name", F.lit("unknown")).alias("class_name")), "id").drop("query_id").orderBy("rank")

    def assign_people(self, group: str = "library", threshold: float = 0.65, most: int = 200_000) -> DataFrame:
        """Faces one after the other, in one task, as each is compared with those before; a library of more than ``most`` faces is refused."""
        faces = self.table("faces").filter("vector is not null").withColumn(group, F.lit(0))
        if faces.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} faces: assign them by album with clustering.online, or to known persons with knn.search and clustering.vote")
        return clustering.online(faces, group, threshold)

    def suppress(self, boxes: DataFrame, iou: float = 0.4) -> DataFrame:
        return suppression.hard(boxes, "image_id", iou)

    def statistics(self) -> DataFrame:
        faces = self.table("faces")
        persons = faces.filter("person_id is not null").select("person_id").distinct()
        return catalog.statistics(self.table("images"), faces, persons, self.table("objects"), self.table("tasks"))

    def evaluate_recall(self, run: DataFrame, relevant: DataFrame) -> DataFrame:
        return evaluation.summary(evaluation.per_query(run, relevant))
