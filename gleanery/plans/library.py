"""Catalog, queue, result and scoring queries: ``documents`` as files, ``events`` as tasks, ``orders`` as a status table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ranking
from ..sources import catalog
from ..streaming import queue
from .registry import query, table
from .similarity import r

#: Of the documents a third is in the catalog as scanned before, and of those some have changed since.
PATH = "concat(source, '/', doc_id, CASE WHEN doc_id % 11 = 0 THEN '.txt' WHEN doc_id % 4 = 0 THEN '.PNG' ELSE '.jpg' END)"
FILES = f"all_files AS (SELECT doc_id, {PATH} AS path, n_chars AS size, doc_id * 10 AS modified_time, sha256(text) AS hash FROM documents), files AS (SELECT * FROM all_files WHERE path NOT LIKE '%.txt')"
IMAGES = "images AS (SELECT doc_id AS id, path, hash, CASE WHEN doc_id % 5 = 0 THEN size + 1 ELSE size END AS size, modified_time, CASE WHEN doc_id % 7 = 0 THEN 'pending' ELSE 'completed' END AS scan_status, CASE WHEN doc_id % 2 = 0 THEN concat(hash, '.jpg') END AS thumbnail_path, CASE WHEN doc_id % 2 = 0 THEN 'generated' ELSE 'pending' END AS thumbnail_status FROM files WHERE doc_id % 3 = 0)"
STATE = """known AS (SELECT DISTINCT hash FROM images), c AS (SELECT f.*, CASE WHEN i.path IS NOT NULL AND i.size = f.size AND i.modified_time = f.modified_time THEN 'unchanged' WHEN i.path IS NOT NULL THEN 'changed' WHEN k.hash IS NOT NULL THEN 'duplicate' ELSE 'new' END AS state
FROM files f LEFT JOIN images i USING (path) LEFT JOIN known k ON k.hash = f.hash)"""


def files(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    suffix = F.when(d % 11 == 0, ".txt").when(d % 4 == 0, ".PNG").otherwise(".jpg")
    own = table(spark, sf_dir, "documents").select(d, F.concat("source", F.lit("/"), d.cast("string"), suffix).alias("path"), F.col("n_chars").alias("size"), (d * 10).alias("modified_time"), F.sha2("text", 256).alias("hash"))
    return own.filter(text.is_image(F.col("path")))


def images(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    return files(spark, sf_dir).filter(d % 3 == 0).select(
        d.alias("id"), "path", "hash", F.when(d % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "modified_time", F.when(d % 7 == 0, "pending").otherwise("completed").alias("scan_status"),
        F.when(d % 2 == 0, F.concat("hash", F.lit(".jpg"))).alias("thumbnail_path"), F.when(d % 2 == 0, "generated").otherwise("pending").alias("thumbnail_status"),
    )


def tasks(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("id"), (e % 1500).alias("image_id"), F.when(e % 9 == 0, "thumbnail").otherwise("image").alias("task_type"), F.when(e % 4 == 0, "pending").when(e % 4 == 1, "failed").otherwise("completed").alias("status"), (e % 3).cast("int").alias("retry_count")
    )


TASKS = "tasks AS (SELECT event_id AS id, event_id % 1500 AS image_id, CASE WHEN event_id % 9 = 0 THEN 'thumbnail' ELSE 'image' END AS task_type, CASE WHEN event_id % 4 = 0 THEN 'pending' WHEN event_id % 4 = 1 THEN 'failed' ELSE 'completed' END AS status, (event_id % 3)::INT AS retry_count FROM events)"


@query(f"WITH {FILES}, {IMAGES}, {STATE} SELECT path, size, state FROM c")
def catalog_incremental_scan(spark, sf_dir):
    return catalog.classify(files(spark, sf_dir), images(spark, sf_dir)).select("path", "size", "state")


@query(
    f"""WITH {FILES}, {IMAGES}, {STATE} SELECT i.path, coalesce(c.hash, i.hash) AS hash, coalesce(c.size, i.size) AS size, CASE WHEN c.path IS NOT NULL THEN 'pending' ELSE scan_status END AS scan_status FROM images i LEFT JOIN c ON c.path = i.path AND state = 'changed'
    UNION ALL SELECT path, hash, size, 'pending' FROM c WHERE state IN ('new', 'duplicate')"""
)
def catalog_merge(spark, sf_dir):
    own = images(spark, sf_dir)
    merged = catalog.merge_scan(own.select("id", "path", "hash", "size", "modified_time", "scan_status"), catalog.classify(files(spark, sf_dir), own))
    return merged.select("path", "hash", "size", "scan_status")


@query(f"WITH {FILES}, {IMAGES} SELECT hash, count(*) AS copies, min(id) AS first_id FROM images GROUP BY hash HAVING count(*) > 1")
def catalog_duplicates(spark, sf_dir):
    return catalog.duplicates(images(spark, sf_dir))


@query(
    f"""WITH {FILES}, {IMAGES}, {STATE}, {TASKS} SELECT id AS image_id, 'image' AS task_type, 'pending' AS status FROM images WHERE scan_status = 'pending' AND path IN (SELECT path FROM c)
    AND id NOT IN (SELECT image_id FROM tasks WHERE task_type = 'image' AND status = 'pending')"""
)
def catalog_enqueue(spark, sf_dir):
    own = images(spark, sf_dir)
    return catalog.enqueue(own, catalog.classify(files(spark, sf_dir), own), tasks(spark, sf_dir)).drop("retry_count")


@query(f"WITH {TASKS} SELECT task_type, status, count(*) AS n, count(DISTINCT image_id) AS images, sum(retry_count)::BIGINT AS retries FROM tasks GROUP BY ALL")
def status_counts(spark, sf_dir):
    return tasks(spark, sf_dir).groupBy("task_type", "status").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images"), F.sum("retry_count").alias("retries"))


@query(
    f"""WITH {FILES}, {IMAGES}, {TASKS} SELECT (SELECT count(*) FROM images) AS images, (SELECT count(*) FROM images WHERE thumbnail_status = 'generated') AS thumbnails, (SELECT count(*) FROM embeddings) AS faces,
    (SELECT count(DISTINCT label) FROM embeddings) AS persons, (SELECT count(*) FROM part) AS objects, (SELECT count(*) FROM tasks WHERE status = 'pending') AS pending"""
)
def statistics_row(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return catalog.statistics(images(spark, sf_dir), e, e.select("label").distinct(), table(spark, sf_dir, "part"), tasks(spark, sf_dir))


@query(f"WITH {FILES}, {IMAGES}, {TASKS}, n AS (SELECT (SELECT count(*) FROM images) AS images, (SELECT count(*) FROM tasks WHERE status = 'pending') AS pending) SELECT images, pending, CASE WHEN pending > 0 THEN greatest(images - pending, 0) ELSE images END AS processed FROM n")
def scan_status(spark, sf_dir):
    n = images(spark, sf_dir).agg(F.count("*").alias("images")).join(F.broadcast(tasks(spark, sf_dir).agg(F.count_if(F.col("status") == "pending").alias("pending"))))
    return n.select("images", "pending", catalog.scan_status(False, F.lit(0).cast("long"), F.col("images"), F.col("pending")).alias("processed"))


@query(f"WITH {FILES}, {IMAGES}, l AS (SELECT * FROM images ORDER BY id LIMIT 200) SELECT id, path, thumbnail_path FROM l WHERE thumbnail_path IS NOT NULL")
def library_page(spark, sf_dir):
    """The first 200 rows are the page (the feature's own limit); then those without a thumbnail go."""
    return catalog.library(images(spark, sf_dir)).select("id", "path", "thumbnail_path")


UPDATES = "u AS (SELECT o_orderkey AS id, CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'K' END AS status, l_linenumber AS seq FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def _updates(spark, sf_dir, *more) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "R", "R").otherwise("K").alias("status"), F.col("l_linenumber").alias("seq"), *more)
    return own.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", "left_semi")


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


@query(f"WITH {UPDATES}, l AS (SELECT id, arg_max(status, seq) AS status FROM u GROUP BY id) SELECT o_orderkey AS id, coalesce(l.status, o_orderstatus) AS status FROM orders LEFT JOIN l ON id = o_orderkey")
def upsert_last_wins(spark, sf_dir):
    """Line numbers repeat within an order: of equal ones the first in the files wins, as the SQL takes it read in order (by one thread;
    by several it takes any). A line without a number changes nothing."""
    at = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "row_index")]
    return catalog.upsert(_orders(spark, sf_dir), _updates(spark, sf_dir, *at).filter("seq is not null"), "id", "seq", "file_path", "row_index")


@query(f"WITH {UPDATES}, l AS (SELECT DISTINCT id FROM u WHERE status = 'R') SELECT o_orderkey AS id, CASE WHEN l.id IS NOT NULL THEN 'returned' ELSE o_orderstatus END AS status FROM orders LEFT JOIN l ON l.id = o_orderkey")
def status_update(spark, sf_dir):
    changes = _updates(spark, sf_dir).filter("status = 'R'").select("id", F.lit("returned").alias("value")).distinct()
    return catalog.set_where(_orders(spark, sf_dir), changes, "id", "status")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return catalog.delete_where(table(spark, sf_dir, "lineitem"), gone, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    f"""WITH {FILES}, {IMAGES} SELECT f.doc_id AS image_id, round(size / 1000.0::DOUBLE, 6) AS score, coalesce(thumbnail_path, f.path) AS shown, list_last(string_split(f.path, '/')) AS name, thumbnail_path IS NOT NULL AS has_thumbnail
    FROM files f LEFT JOIN (SELECT id, thumbnail_path FROM images) i ON i.id = f.doc_id"""
)
def result_left_join_thumb(spark, sf_dir):
    found = files(spark, sf_dir).select(F.col("doc_id").alias("image_id"), "path", r(F.col("size") / 1000.0).alias("score"))
    return catalog.results(found, images(spark, sf_dir))


@query(f"WITH {TASKS} SELECT id, image_id FROM tasks WHERE task_type = 'image' AND status = 'pending' ORDER BY id LIMIT 100")
def task_queue_batch(spark, sf_dir):
    """The next batch of the queue: its size is the feature."""
    return queue.pending(tasks(spark, sf_dir)).select("id", "image_id")


@query(f"WITH {FILES}, {IMAGES}, {TASKS} SELECT t.id, t.image_id, CASE WHEN i.id IS NULL THEN 'failed' ELSE 'completed' END AS status, (retry_count + (i.id IS NULL)::INT)::INT AS retry_count FROM tasks t LEFT JOIN images i ON i.id = t.image_id")
def retry_increment(spark, sf_dir):
    return queue.outcomes(tasks(spark, sf_dir), images(spark, sf_dir)).withColumn("retry_count", F.col("retry_count").cast("int"))


@query(
    f"""WITH {FILES} SELECT doc_id, path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS extension, CASE WHEN length(list_last(string_split(path, '/'))) > 8 THEN concat(list_last(string_split(path, '/'))[:5], '...') ELSE list_last(string_split(path, '/')) END AS shown,
    path LIKE '%.PNG' AS png, right(path, 6) AS tail FROM files"""
)
def path_functions(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("doc_id", "path", text.extension(p).alias("extension"), text.shortened(text.file_name(p), 8).alias("shown"), p.endswith(".PNG").alias("png"), F.right(p, F.lit(6)).alias("tail"))


@query(f"WITH {FILES} SELECT hash[:2] AS shard, count(*) AS n, min(concat(hash[:2], '/', hash, '.jpg')) AS first FROM files GROUP BY shard")
def hash_prefix(spark, sf_dir):
    h = F.col("hash")
    return files(spark, sf_dir).groupBy(F.substring(h, 1, 2).alias("shard")).agg(F.count("*").alias("n"), F.min(text.thumbnail_path(h)).alias("first"))


@query(
    """WITH d AS (SELECT doc_id, n_chars * n_chars AS n FROM documents) SELECT doc_id, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0::DOUBLE) ELSE printf('%d B', n) END AS size,
    CASE WHEN n >= 1000000 THEN 'M' WHEN n >= 1000 THEN 'K' ELSE '' END AS unit FROM d"""
)
def human_size(spark, sf_dir):
    n = F.col("n_chars") * F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", text.human_size(n).alias("size"), F.regexp_extract(text.short_number(n), "[MK]$", 0).alias("unit"))


@query("SELECT page_id, concat('data:', CASE WHEN lower(url) LIKE '%.png' THEN 'image/png' WHEN lower(url) LIKE '%.webp' THEN 'image/webp' WHEN lower(url) LIKE '%.gif' THEN 'image/gif' ELSE 'image/jpeg' END, ';base64,', to_base64(encode(html))) AS url_data FROM pages")
def data_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.data_url(F.col("url"), F.col("html").cast("binary")).alias("url_data"))


MATCHES = """m AS (SELECT l_orderkey % 50 AS query_patch, l_partkey % 500 AS image, l_linenumber AS candidate, (l_quantity)::INT AS matches, (l_quantity * (1 - l_discount * 5))::INT AS inliers, l_tax * 10 AS color, l_discount * 10 AS overlap FROM lineitem),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_patch, image ORDER BY inliers DESC, candidate, matches, color, overlap) AS n FROM m WHERE inliers > 0) WHERE n = 1),
agg AS (SELECT image, sum(inliers)::BIGINT AS inliers, sum(matches)::BIGINT AS matches, count(DISTINCT query_patch) AS matched, sum(color) AS color, sum(overlap) AS overlap, var_pop(query_patch / 50.0) AS variance FROM best GROUP BY image),
mul AS (SELECT *, (0.5 + 0.5 * color / matched) * (0.5 + 0.5 * overlap / matched) AS mult, inliers::DOUBLE / matches AS ratio FROM agg)"""


def _matches(spark, sf_dir) -> DataFrame:
    q = F.col("l_quantity")
    own = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("query_patch"), (F.col("l_partkey") % 500).alias("image"), F.col("l_linenumber").alias("candidate"), F.round(q).cast("int").alias("matches"), F.rint(q * (1 - F.col("l_discount") * 5)).cast("int").alias("inliers"),
        (F.col("l_tax") * 10).alias("color"), (F.col("l_discount") * 10).alias("overlap"),
    )
    best = ranking.first_per_key(own.filter("inliers > 0").withColumn("key", F.struct("query_patch", "image")), "key", F.desc("inliers"), "candidate", "matches", "color", "overlap")
    return best.groupBy("image").agg(
        F.sum("inliers").alias("inliers"), F.sum("matches").alias("matches"), F.count_distinct("query_patch").alias("matched"), F.sum("color").alias("color"), F.sum("overlap").alias("overlap"), F.var_pop(F.col("query_patch") / 50.0).alias("variance")
    )


@query(
    f"""WITH {MATCHES} SELECT image, inliers, matched, round(ratio * sqrt(inliers) * (1 + 0.5 * matched / 50) * mult, 4) AS object_mode,
    round(inliers * ratio * CASE WHEN matched >= 3 THEN greatest(1 - variance, 0.3) ELSE 1 END * greatest(ln(1 + matched), 1) * mult, 4) AS scene_mode FROM mul"""
)
def patch_confidence_modes(spark, sf_dir):
    m = _matches(spark, sf_dir)
    c = F.col
    return m.select(
        "image", "inliers", "matched", r(ranking.object_confidence(c("inliers"), c("matches"), c("matched"), c("color"), c("overlap"), 50), 4).alias("object_mode"),
        r(ranking.scene_confidence(c("inliers"), c("matches"), c("matched"), c("matched"), c("variance"), c("color"), c("overlap")), 4).alias("scene_mode"),
    )


@query(
    f"""WITH {MATCHES}, f AS (SELECT image % 100 AS path, image, least(inliers / 1000.0, 1) AS e, ratio, overlap / matched AS o FROM mul), s AS (SELECT *, 0.3 * e + 0.5 * ratio + 0.2 * o AS score FROM f),
    n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(score, 9) DESC, image) AS n FROM s WHERE ratio >= 0.5) SELECT path, image, round(score, 6) AS score FROM n WHERE n = 1"""
)
def fusion_rank(spark, sf_dir):
    c = F.col
    m = _matches(spark, sf_dir).select((c("image") % 100).alias("path"), "image", F.least(c("inliers") / 1000.0, F.lit(1.0)).alias("e"), (c("inliers") / c("matches")).alias("ratio"), (c("overlap") / c("matched")).alias("o"))
    scored = m.filter("ratio >= 0.5").withColumn("score", ranking.fusion(c("e"), c("ratio"), c("o")))
    return ranking.first_per_key(scored, "path", F.desc(F.round("score", 9)), "image").select("path", "image", r("score").alias("score"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """An extension: tumbling windows, the same code over a stream with a watermark."""
    return queue.windowed(table(spark, sf_dir, "events"), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))
