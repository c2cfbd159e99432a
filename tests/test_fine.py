"""Second stages of the searches on rows made by hand."""

import pytest
from pyspark.sql import functions as F

from gleanery.engine import Engine
from gleanery.operators import fine


def test_objects_are_taken_in_coarse_order_and_then_ranked(spark):
    candidates = spark.createDataFrame(
        [(1, 10, "a", 0.9, 1, 0.1), (1, 11, "b", 0.8, 2, 0.9), (1, 12, "c", 0.8, 3, 0.9), (1, 13, "b", 0.7, 4, 0.9), (1, 14, "d", 0.7, 5, 1.0), (1, 15, "e", 0.6, 6, 1.0)],
        "query_id long, image_id long, path string, score double, rank int, overlap double",
    )
    matched = spark.createDataFrame([(1, 10, 9, 10, 5), (1, 11, 9, 10, 10), (1, 12, 0, 10, 10), (1, 13, 9, 10, 9), (1, 15, 9, 0, 0)], "query_id long, image_id long, keypoints int, matches int, inliers int")
    got = fine.objects(candidates, matched, 3).orderBy("rank").collect()
    # 12 has no keypoints and 14 no match, so 13 is the third; its path is 11's; 15 comes too late
    assert [(r.rank, r.image_id, r.path, round(r.confidence, 6)) for r in got] == [(1, 11, "b", 0.92), (2, 10, "a", 0.54)]
    assert [r.image_id for r in fine.objects(candidates, matched, 6, least=0.3).orderBy("rank").collect()] == [11, 10, 15]
    assert [r.image_id for r in fine.objects(candidates, matched, 6, take=1).collect()] == [10]
    assert fine.objects(candidates.limit(0), matched, 3).count() == 0 and fine.objects(candidates, matched.limit(0), 3).count() == 0


def _patches(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, id long, patch_index int, num_keypoints int, x double, y double, w double, h double")


def test_richest_is_stable(spark):
    p = _patches(spark, [(1, i, i, n, 0.0, 0.0, 1.0, 1.0) for i, n in enumerate((5, 9, 5, 1))], "query_image")
    assert [r.id for r in fine.richest(p, "query_image", 2).orderBy("id").collect()] == [0, 1]


def test_patches(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    query = _patches(spark, [(1, 0, 0, 9, *box), (1, 1, 1, 9, 20.0, 0.0, 10.0, 10.0), (2, 5, 0, 9, *box), (2, 6, 1, 9, *box), (2, 7, 2, 9, *box)], "query_image")
    stored = _patches(spark, [(7, 70, 0, 9, *box), (7, 71, 1, 9, 1.0, 0.0, 10.0, 10.0), (7, 72, 2, 3, *box), (8, 80, 0, 9, *box), (9, 90, 0, 9, 50.0, 50.0, 10.0, 10.0)], "image_id")
    coarse = spark.createDataFrame([(q, i, 1.0) for q in (1, 2) for i in (7, 8, 9)], "query_image long, image_id long, votes double")
    pairs = fine.patch_pairs(query, coarse, stored)
    assert {(r.query_patch, r.patch) for r in pairs.filter("query_image = 1").collect()} == {(0, 70), (0, 71), (0, 80)}  # 72 has few keypoints, 90 and query patch 1 lie elsewhere
    rows = [(0, 70, 8, 4, 1.0), (0, 71, 9, 4, 0.0), (0, 80, 8, 2, 1.0), *[(q, p, 20, 16, 1.0) for q in (5, 6, 7) for p in (70, 80)], (6, 71, 20, 20, 0.5)]
    matched = spark.createDataFrame(rows, "query_patch long, patch long, matches int, inliers int, color double")
    got = {(r.query_image, r.image_id): r for r in fine.patches(pairs, matched, query, 5).collect()}
    # of equals the first candidate counts; two inliers are too few
    assert set(got) == {(1, 7), (2, 7), (2, 8)}
    assert (got[1, 7].inliers, got[1, 7].matches, got[1, 7].matched) == (4, 8, 1)
    assert got[1, 7].confidence == pytest.approx(0.5 * 2 * (1 + 0.5 * 1 / 2))
    assert got[2, 8].confidence == pytest.approx(48 * 0.8 * 1.3862943611)
    assert (got[2, 7].inliers, got[2, 7].rank, got[2, 8].rank) == (52, 1, 2)
    assert fine.patches(pairs, matched.limit(0), query, 5).count() == 0


def test_query_face(spark):
    rows = [
        (1, 0, 0.9, 0, 0, 100, 100, 10, 10, 50, 10), (1, 1, 0.2, 0, 0, 300, 300, 10, 10, 50, 10), (1, 2, 0.9, 0, 0, 100, 100, 10, 10, 50, 10), (1, 3, 0.4, 0, 0, 200, 200, -60, 10, 50, 10),
        (2, 0, 0.9, 0, 0, 10, 10, 0, 0, 50, 10), (2, 1, 0.9, 0, 0, 100, 100, 0, 0, 5, 10),
    ]
    faces = spark.createDataFrame(rows, "image long, face long, score double, x1 int, y1 int, x2 int, y2 int, ax int, ay int, bx int, by int")
    assert [(r.image, r.face) for r in fine.query_face(faces, "image").collect()] == [(1, 0)]  # weak, weak with eyes outside, small, eyes too near


def test_engine_runs_the_fine_stages(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "warehouse"))
    e.append("images", spark.createDataFrame([(7, "p7", "h", 1, 1, "done", None, "pending")], e.table("images").schema))
    rows = [(70, 7, 0, 9, 0.0, 0.0, 10.0, 10.0, [1.0, 0.0]), (80, 8, 0, 9, 0.0, 0.0, 10.0, 10.0, [0.6, 0.8])]
    e.append("patches", spark.createDataFrame(rows, e.table("patches").schema))
    query = e.table("patches").filter("id = 70").withColumn("query_image", F.lit(1).cast("long"))
    coarse = e.search_patches(query)
    assert [(r.image_id, round(r.votes, 6)) for r in coarse.orderBy("image_id").collect()] == [(7, 1.0), (8, 0.6)]
    pairs = e.patch_pairs(query, coarse)
    matched = pairs.select("query_patch", "patch", F.lit(8).alias("matches"), F.lit(4).alias("inliers"), F.lit(1.0).alias("color"))
    assert {(r.image_id, r.path, r.inliers) for r in e.rank_patches(pairs, matched, query).collect()} == {(7, "p7", 4), (8, "", 4)}
    e.append("objects", spark.createDataFrame([(70, 7, None, 1.0, [1.0, 0.0])], e.table("objects").schema))
    found = e.search_objects(query.select("id", "vector"), 5).withColumn("overlap", F.lit(0.5))
    done = e.rank_objects(found, found.select("query_id", "image_id", F.lit(5).alias("keypoints"), F.lit(4).alias("matches"), F.lit(2).alias("inliers")), 5)
    assert [(r.path, round(r.confidence, 6)) for r in done.collect()] == [("p7", 0.65)]
    e.append("faces", spark.createDataFrame([(1, 7, None, [1.0, 0.0], 1.0, "stored"), (2, 7, None, [0.0, 1.0], 1.0, "stored")], e.table("faces").schema))
    faces = spark.createDataFrame([(3, 0, 0.9, 0, 0, 100, 100, 10, 10, 50, 10, [0.0, 1.0])], "image long, face long, score double, x1 int, y1 int, x2 int, y2 int, ax int, ay int, bx int, by int, vector array<float>")
    assert [(r.query_id, r.path, r.id) for r in e.search_person_image(faces, 0.9).collect()] == [(3, "p7", 2)]
    with pytest.raises(ValueError):
        e.assign_people(most=1)


def test_replaced_tables_survive_a_cut(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "warehouse"))
    one = spark.createDataFrame([(1, 1, "image", "pending", 0)], e.table("tasks").schema)
    e.append("tasks", one)
    e.replace("tasks", e.table("tasks").withColumn("status", F.lit("failed")))  # reads what it replaces
    assert [r.status for r in e.table("tasks").collect()] == ["failed"]
    one.write.parquet(str(tmp_path / "warehouse" / ".tasks"))  # whole, but the old table is still there
    assert [r.status for r in e.table("tasks").collect()] == ["failed"]
    (tmp_path / "warehouse" / "tasks").rename(tmp_path / "gone")
    assert [r.status for r in e.table("tasks").collect()] == ["pending"]
    folder = tmp_path / "photos"
    folder.mkdir()
    (folder / "a.jpg").write_bytes(b"one")
    e.scan(str(folder))
    (folder / "b.jpg").write_bytes(b"two")
    assert sorted(r.state for r in e.scan(str(folder)).collect()) == ["new", "unchanged"] and e.table("images").count() == 2


def test_pairs_of_chosen_rows(spark):
    from gleanery.operators import pairs

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, name string")
    assert sorted((r.id, r.id2, r.name, r.name2) for r in pairs.of_chosen(rows, "id").collect()) == [(1, 2, "a", "b"), (1, 3, "a", None), (2, 3, "b", None)]
    assert pairs.of_chosen(rows.limit(0), "id").count() == 0
    with pytest.raises(ValueError):
        pairs.of_chosen(rows, "id", 2)


def test_blocks_of_queries_give_what_one_block_gives(spark, sf, monkeypatch):
    from gleanery.operators import knn
    from gleanery.plans.similarity import vectors

    v = vectors(spark, sf)
    rows = lambda **by: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in knn.search(v, v.filter("id % 5 = 0"), **by).collect())
    want = rows(k=3), rows(least=0.3)
    monkeypatch.setattr(knn, "QUERY_FLOATS", 0)
    monkeypatch.setattr(knn, "PACKED_FLOATS", 1000)
    assert (rows(k=3), rows(least=0.3)) == want
