import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gleanery.engine import Engine
from gleanery.functions import geometry, image, text, vector
from gleanery.operators import clustering, evaluation, knn, models, ranking, suppression
from gleanery.plans import library
from gleanery.sources import catalog, vectors
from gleanery.streaming import queue


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_vector_functions(spark):
    r = one(
        spark,
        vector.cosine(arr(1, 0, 0), arr(0, 1, 0)),
        vector.cosine(arr(1, 0, 0), arr(2, 0, 0)),
        vector.cosine(arr(0, 0), arr(1, 0)),
        vector.cosine_clamped(arr(0, 0), arr(1, 0)),
        vector.dot(arr(1, 2), arr(1, 2, 3)),
        vector.normalized(arr(3, 4)),
        vector.normalized(arr(0, 0)),
        vector.early_exit(F.lit(5), arr(1), F.lit(500), arr(1), 200, 0.7),
        vector.early_exit(F.lit(5), arr(1), F.lit(6), arr(1, 2), 200, 0.7),
    )
    assert list(r)[:5] == [0.0, 1.0, 0.0, 0.0, None]
    assert r.c5 == [0.6, 0.8] and r.c6 == [0.0, 0.0] and r.c7 and not r.c8


def test_prototype_of_axes_and_single(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("a", [0.0, 1.0, 0.0]), ("a", [0.0, 0.0, 1.0]), ("b", [3.0, 4.0, 0.0]), ("c", None)], "k string, v array<float>")
    got = {r.k: r.prototype for r in vector.prototypes(df, "k", "v").collect()}
    assert np.allclose(got["a"], [1 / math.sqrt(3)] * 3) and got["b"] == [3.0, 4.0, 0.0] and "c" not in got


def test_geometry(spark):
    ints = [F.lit(x) for x in (0, 0, 10, 10, 5, 5, 10, 10)]
    same = [F.lit(x) for x in (0, 0, 10, 10, 0, 0, 10, 10)]
    apart = [F.lit(x) for x in (0, 0, 10, 10, 10, 0, 10, 10)]
    src = [(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (10, 0), (5, 5), (2, 9), (8, 9))]
    dst = [(2 * y + 3.0, -2 * x + 1.0) for x, y in ((0, 0), (10, 0), (5, 5), (2, 9), (8, 9))]
    t = geometry.similarity_transform(src, dst)
    r = one(spark, geometry.iou_xywh(*ints), geometry.iou_xywh(*same), geometry.iou_xywh(*apart), t["a"], t["b"], t["tx"], t["ty"], *geometry.clamp_box(F.lit(-5), F.lit(90), F.lit(500), F.lit(50), F.lit(100), F.lit(100)))
    assert abs(r.c0 - 25 / 175) < 1e-9 and r.c1 == 1.0 and r.c2 == 0.0
    assert np.allclose([r.c3, r.c4, r.c5, r.c6], [0, -2, 3, 1])
    assert list(r)[7:] == [0, 90, 100, 10]


def test_tiles_drop_slivers(spark):
    tiles = one(spark, geometry.tiles(F.lit(520), F.lit(300))).c0
    assert [(t.x, t.y, t.w, t.h) for t in tiles] == [(0, 0, 512, 300), (256, 0, 264, 300), (0, 256, 512, 44), (256, 256, 264, 44)]


def test_image_functions(spark):
    px = lambda r, g, b: (F.lit(r), F.lit(g), F.lit(b))
    r = one(
        spark,
        image.hue(*px(255, 0, 0)), image.hue(*px(255, 0, 128)), image.hsv_bin(*px(255, 0, 0)), image.hsv_bin(*px(0, 0, 0)), image.packed(*px(1, 2, 3)),
        image.image_type(F.lit(100), F.lit(900), F.lit(7.0), F.lit(0.2), F.lit(999), F.lit(50.0)), image.image_type(F.lit(400), F.lit(300), F.lit(7.0), F.lit(0.2), F.lit(999), F.lit(50.0)),
        image.face_quality_angles(F.lit(1.0), F.lit(1.0), F.lit(20000.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), image.reject_reason(F.lit(0.4), F.lit(0.5), F.lit(20), F.lit(0.5), F.lit(False)), image.bucket(F.lit(0.7)),
    )
    assert r.c0 == 0 and abs(r.c1 - 329.88) < 0.01 and r.c2 == 1 and r.c3 == 0 and r.c4 == 66051
    assert (r.c5, r.c6, r.c7, r.c8, r.c9) == ("unknown", "photo", 1.0, "detector", "yellow")


def test_text_functions(spark):
    r = one(spark, text.human_size(F.lit(1536)), text.human_size(F.lit(5)), text.file_name(F.lit("a\\b/c.JPG")), text.is_image(F.lit("x.HEIC")), text.is_image(F.lit("x.txt")), text.shortened(F.lit("a" * 25)), text.suffix(F.lit("image/png")), text.suffix(F.lit("x")))
    assert list(r) == ["1.50 KB", "5 B", "c.JPG", True, False, "a" * 17 + "...", "png", "jpg"]


def test_knn_ties_zero_vectors_blocks_and_empty(spark, monkeypatch):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0]), (5, None)], "id long, vector array<float>")
    q = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 3.0])], "id long, vector array<float>")
    want = {(10, 1, 1), (10, 2, 2), (11, 4, 1), (11, 1, 2)}
    assert {(r.query_id, r.id, r["rank"]) for r in knn.search(v, q, k=2).collect()} == want
    monkeypatch.setattr(knn, "QUERY_FLOATS", 1)  # one query a block
    assert {(r.query_id, r.id, r["rank"]) for r in knn.search(v, q, k=2).collect()} == want
    assert knn.search(v, q.limit(0), k=2).count() == 0 and knn.search(v.limit(0), q, k=2).count() == 0
    assert {r.id for r in knn.search(v, q, least=0.9).collect()} == {1, 2, 4}


def test_suppression(spark):
    boxes = spark.createDataFrame(
        [("a", 1, 0.9, 0.0, 0.0, 10.0, 10.0), ("a", 2, 0.8, 1.0, 1.0, 11.0, 11.0), ("a", 3, 0.7, 50.0, 50.0, 60.0, 60.0), ("b", 4, 0.5, 0.0, 0.0, 0.0, 0.0)], "g string, id long, score double, x1 double, y1 double, x2 double, y2 double"
    )
    assert {r.id for r in suppression.hard(boxes, "g").collect()} == {1, 3, 4}
    faces = boxes.withColumn("eye_x", (F.col("x1") + F.col("x2")) / 2).withColumn("eye_y", F.col("y1"))
    got = {r.id: r.score for r in suppression.soft(faces, "g").collect()}
    assert got == {1: 0.9, 3: 0.7, 4: 0.5}  # the twin decays below the least score; scores stay the original ones
    near = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("xywh", b, strict=True)]) for b in ((0, 0, 100, 100), (5, 5, 100, 100), (30, 0, 100, 100))])
    assert [b.x for b in one(spark, suppression.adjacent(near)).c0] == [0, 30]


def test_ranking(spark):
    r = one(spark, ranking.fusion(F.lit(1.0), F.lit(0.5), F.lit(0.5)), ranking.object_confidence(F.lit(0), F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0)), ranking.object_confidence(F.lit(4), F.lit(8), F.lit(2), F.lit(2.0), F.lit(2.0)))
    assert abs(r.c0 - 0.65) < 1e-9 and r.c1 == 0.0 and abs(r.c2 - 0.5 * 2 * 2) < 1e-9
    df = spark.createDataFrame([(1, 1, 5, 0.0), (1, 1, 6, 3.0), (1, 1, 7, 3.0), (2, 1, 1, 0.0)], "q int, i int, c int, s double")
    assert [(x.q, x.c) for x in ranking.best_candidate(df, "q", "i", "c", "s").collect()] == [(1, 6)]


def test_clustering(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 2, [0.99, 0.1]), (0, 3, [0.0, 1.0]), (0, 4, [0.05, 1.0])]
    got = {r.id: r.person_id for r in clustering.online(spark.createDataFrame(rows, "g int, id long, vector array<float>"), "g").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}  # the nearest opens the vote, but more of the k nearest are of person 1
    near = {r.id: r.person_id for r in clustering.online(spark.createDataFrame(rows, "g int, id long, vector array<float>"), "g", k=1).collect()}
    assert near == {1: 1, 2: 1, 3: 3, 4: 3}


def test_evaluation(spark):
    run = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 2, "w")], "query string, rank int, candidate string")
    relevant = spark.createDataFrame([("a", "x"), ("b", "w")], "query string, candidate string")
    s = evaluation.summary(evaluation.per_query(run, relevant)).first()
    assert (s.n_queries, s.recall_1, s.recall_5, s.top_1_accuracy, s.mrr, s.coverage) == (2, 0.5, 1.0, 0.5, 0.75, 1.0)
    empty = evaluation.summary(evaluation.per_query(run, relevant.limit(0))).first()
    assert empty.n_queries == 0 and empty.recall_1 == 0.0


def test_vector_codecs(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, None)], "id long, vector array<float>")
    back = vectors.decode(vectors.encode(df)).orderBy("id").collect()
    assert back[0].vector == [1.0, 2.0, 3.0, 4.0] and back[1].vector is None
    odd = spark.createDataFrame([(bytearray(b"\0\0\x80?\1"),)], "blob binary")
    assert vectors.decode(odd).first().vector is None and vectors.decode(odd, tolerant=True).first().vector == [1.0]
    head = vectors.MAGIC + (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + (2).to_bytes(8, "little") + b"model".ljust(64, b"\0")
    (tmp_path / "store.bin").write_bytes(head + np.array([1, 2, 3, 4], "<f4").tobytes())
    (tmp_path / "bad.bin").write_bytes(b"nothing")
    assert [(r.id, r.vector) for r in vectors.read_store(spark, str(tmp_path)).orderBy("id").collect()] == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    with pytest.raises(Exception, match="wrong length"):
        vectors.append(df.filter("id = 1"), str(tmp_path / "out"), 3)


def test_engine_end_to_end(spark, tmp_path):
    folder = tmp_path / "photos" / "deep"
    folder.mkdir(parents=True)
    for name, data in (("a.jpg", b"one"), ("b.PNG", b"two"), ("copy.jpg", b"one"), ("note.txt", b"x")):
        (folder / name).write_bytes(data)
    e = Engine(spark, str(tmp_path / "warehouse"))
    assert e.statistics().first().images == 0
    assert {r.state for r in e.scan(str(tmp_path / "photos")).collect()} == {"new"} or e.table("images").count() == 3
    assert e.table("images").count() == 3 and e.table("tasks").count() == 3
    assert e.table("images").select("id").distinct().count() == 3
    e.scan(str(tmp_path / "photos"))
    assert e.table("images").count() == 3 and e.table("tasks").count() == 3
    assert {r.status for r in e.process().collect()} == {"completed"}
    assert e.table("tasks").filter("status = 'pending'").count() == 0
    made = models.apply(e.table("images").select("id", F.col("hash").alias("content")), "stub", models.stub_embedder(8), "id long, vector array<float>")
    rows = made.select("id", F.col("id").alias("image_id"), F.lit(None).cast("long").alias("person_id"), "vector", F.lit(1.0).alias("quality"), F.lit("stored").alias("storage_status"))
    e.append("faces", rows)
    q = e.table("faces").orderBy("id").limit(1).select("id", "vector")
    assert e.search_person(q, 0.99).count() == 2  # the copy has the same content
    assert e.assign_people(threshold=0.99).select("person_id").distinct().count() == 2
    e.append("objects", e.table("faces").select("id", "image_id", F.lit(None).cast("string").alias("class_name"), F.lit(0.9).cast("float").alias("confidence"), "vector"))
    assert e.search_objects(q, 5).count() >= 2 and e.search_category(q, 0.99).first().class_name == "unknown"
    e.clear()
    assert e.statistics().first().images == 0


def test_changed_file_is_updated_and_queued(spark):
    images = spark.createDataFrame([(1, "p", "h1", 5, 10, "completed")], "id long, path string, hash string, size long, modified_time long, scan_status string")
    files = spark.createDataFrame([("p", 6, 11, "h2"), ("q", 1, 1, "h1")], "path string, size long, modified_time long, hash string")
    found = catalog.classify(files, images)
    assert {r.path: r.state for r in found.collect()} == {"p": "changed", "q": "duplicate"}
    merged = {r.path: r for r in catalog.merge_scan(images, found).collect()}
    assert merged["p"].hash == "h2" and merged["p"].scan_status == "pending" and merged["q"].id == 2


def test_changed_file_without_hash_is_queued(spark):
    images = spark.createDataFrame([(1, "p", "h1", 5, 10, "completed")], "id long, path string, hash string, size long, modified_time long, scan_status string")
    files = spark.createDataFrame([("p", 6, 11, None)], "path string, size long, modified_time long, hash string")
    assert [(r.hash, r.size, r.scan_status) for r in catalog.merge_scan(images, catalog.classify(files, images)).collect()] == [("h1", 6, "pending")]


def test_new_ids_cover_rows_that_count_and_result_partition_differently(spark):
    """Wide rows: adaptive planning leaves more partitions of them than of the counted column alone."""
    table = spark.createDataFrame([(7,)], "id long")
    rows = spark.range(40_000).select(F.concat(F.lit("p"), F.xxhash64("id").cast("string")).alias("path"), F.concat(*[F.sha2(F.concat("id", F.lit(f"{k}")), 512) for k in range(4)]).alias("hash"))
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        got = catalog.with_ids(rows, table, "path").toPandas().sort_values("id")
    finally:
        for k in sizes:
            spark.conf.unset(k)
    assert got["id"].tolist() == list(range(8, 40_008)) and got["path"].is_monotonic_increasing
    assert catalog.with_ids(rows.limit(0), table, "path").count() == 0
    assert [r.id for r in catalog.with_ids(spark.createDataFrame([(None,), ("b",), ("a",)], "path string"), table, "path").orderBy("path").collect()] == [8, 9, 10]


def test_of_equal_line_numbers_the_first_in_the_files_wins(spark, tmp_path):
    """The later file is the larger, which a scan takes first."""
    schema = "l_orderkey long, l_linenumber int, l_returnflag string"
    (tmp_path / "sf" / "lineitem.parquet").mkdir(parents=True)
    for name, rows in (("a", [(1, 2, "R"), (2, 1, "N"), (3, None, "R")]), ("b", [(1, 2, "N"), (2, 1, "R"), (1, 1, "N"), *[(k, 1, "R") for k in range(10, 4000)]])):
        pq.write_table(spark.createDataFrame(rows, schema).toArrow(), tmp_path / "sf" / "lineitem.parquet" / f"{name}.parquet")
    spark.createDataFrame([(1, "O"), (2, "O"), (3, "F")], "o_orderkey long, o_orderstatus string").write.parquet(str(tmp_path / "sf" / "orders.parquet"))
    got = {r.id: r.status for r in library.upsert_last_wins(spark, str(tmp_path / "sf")).collect()}
    assert got == {1: "R", 2: "K", 3: "F"}


def test_queue_stream_processes_each_file_once(spark, tmp_path):
    schema = "id long, image_id long, task_type string, status string, retry_count int"
    images = spark.createDataFrame([Row(id=1)])
    source, target = str(tmp_path / "tasks"), str(tmp_path / "done")
    spark.createDataFrame([(1, 1, "image", "pending", 0), (1, 1, "image", "pending", 0)], schema).coalesce(1).write.parquet(source)
    go = lambda: queue.start(spark, source, schema, lambda df: queue.outcomes(df, images), target, str(tmp_path / "ckpt")).awaitTermination(120)
    go()
    spark.createDataFrame([(2, 9, "image", "pending", 0)], schema).coalesce(1).write.mode("append").parquet(source)
    go()
    got = {r.id: (r.status, r.retry_count) for r in spark.read.parquet(target).collect()}
    assert got == {1: ("completed", 0), 2: ("failed", 1)} and spark.read.parquet(target).count() == 2


def test_windowed_stream_counts(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = queue.windowed(stream, "ts", "event_type").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()


def test_lsh_recall_against_brute_force(spark, sf):
    """Neighbours within the query's distance: at least nine of ten are found."""
    from gleanery.plans import catalogue, similarity

    v = {r.id: r.vector for r in similarity.vectors(spark, sf).collect()}
    want = {(q, i) for q in v if q % 20 == 0 for i in v if sum((a - b) ** 2 for a, b in zip(v[q], v[i], strict=True)) ** 0.5 < 1.2}
    got = {(r.query_id, r.id) for r in catalogue.QUERIES["lsh_ann"](spark, sf).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
