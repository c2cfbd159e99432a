import pytest
from pyspark.sql import functions as F

from gleanery.functions import keypoints
from gleanery.sources import files


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_keypoints(spark):
    flat = F.array(*[F.lit(float(x)) for x in (0, 0, 256, 256)])
    scores = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r = one(spark, keypoints.normalized(flat, F.lit(512), F.lit(512)), keypoints.best_class(scores(0.1, 0.7, 0.7)), keypoints.best_class(scores(-1, 0)), keypoints.in_ellipse(F.lit(56), F.lit(53)), keypoints.in_ellipse(F.lit(0), F.lit(0)))
    assert r.c0 == [-1, -1, 0, 0] and tuple(r.c1) == (1, 0.7) and tuple(r.c2) == (0, 0.0) and r.c3 and not r.c4
    assert keypoints.landmarks(2.0, 1.0)[0] == (38.2946 * 2, 51.6968 * 2 + 1)


def test_strongest_is_unsorted_when_few(spark):
    points = F.array(*[F.struct(F.lit(s).alias("score"), F.lit(i).alias("i")) for i, s in enumerate((0.1, 0.9, 0.5))])
    r = one(spark, keypoints.strongest(points, 3), keypoints.strongest(points, 2))
    assert [p.i for p in r.c0] == [0, 1, 2] and [p.i for p in r.c1] == [1, 2]


def test_files(spark, tmp_path):
    (tmp_path / "ab").mkdir()
    (tmp_path / "ab" / "abc.jpg").write_bytes(b"12345")
    (tmp_path / "ab" / "x.txt").write_bytes(b"1")
    s = files.folder_statistics(spark, str(tmp_path), "*.jpg").first()
    assert (s.files, s.bytes) == (1, 5)
    images = spark.createDataFrame([("p", "abc"), ("q", "abd"), ("r", "abd")], "path string, hash string")
    existing = spark.createDataFrame([(str(tmp_path / "ab" / "abc.jpg"),)], "path string")
    assert [tuple(r) for r in files.thumbnail_plan(images, existing).select("path", "thumbnail_path").collect()] == [("q", "ab/abd.jpg")]
    out = tmp_path / "out"
    out.mkdir()
    rows = spark.createDataFrame([(str(tmp_path / "ab" / "x.txt"),), (str(tmp_path / "none"),)], "path string")
    assert {r.copied for r in files.export(rows, str(out)).collect()} == {True, False} and (out / "x.txt").exists()
    with pytest.raises(OSError):
        files.export(rows.filter("path like '%none'"), str(out))


def test_reports_and_checks(spark):
    made = spark.createDataFrame([("generated",), ("failed",)], "status string")
    assert tuple(files.thumbnail_report(made, F.lit(0)).first()) == (2, 1, 1, 0.0)
    c = [F.lit(x) for x in (100, 100, 90, 0, 20, 5)]
    r = one(spark, files.crop_error(*c), files.crop_error(*c[:4], F.lit(0), F.lit(5)), files.query_name(F.lit("image/webp"), F.lit(b"1234")), files.query_name(F.lit("x"), F.lit(b"1")))
    assert list(r) == ["outside", "empty", "query_image.webp", None]


def test_ground_truth(spark):
    text = ["# none", "q1.jpg:", "  relevant:", "    - a.jpg", "    - 'b.jpg'", "  irrelevant:", "    - c.jpg"]
    got = {(r.query, r.candidate, r.relevant) for r in files.ground_truth(spark, text).collect()}
    assert got == {("q1.jpg", "a.jpg", True), ("q1.jpg", "b.jpg", True), ("q1.jpg", "c.jpg", False)}


def test_small_helpers(spark):
    from gleanery.functions import geometry, text
    from gleanery.operators import evaluation
    from gleanery.sources import catalog

    r = one(
        spark, text.unfixed(text.fixed(F.lit("ab"), 8)), F.length(text.fixed(F.lit("ab"), 8)), text.percent(F.lit(0.125)), evaluation.reduction(F.lit(4), F.lit(1)), evaluation.reduction(F.lit(0), F.lit(0)),
        evaluation.counts_agree(F.lit(11), F.lit(10), 0.1), evaluation.counts_agree(F.lit(1), F.lit(0), 0.1), geometry.eye_distance(F.lit(0), F.lit(0), F.lit(3), F.lit(4)),
    )
    assert list(r) == ["ab", 8, "12.5%", 75.0, 0.0, True, False, 5.0]
    t = spark.createDataFrame([(1, "a"), (2, None)], "id long, c string")
    assert [x.c for x in catalog.migrate(t, "c", "string", "z").orderBy("id").collect()] == ["a", "z"]
    assert [x.d for x in catalog.migrate(t, "d", "int", 0).collect()] == [0, 0]
    assert {x.id for x in catalog.rekey(t, spark.createDataFrame([(1, 9)], "id long, new_id long")).collect()} == {9, 2}
    rows = spark.createDataFrame([(2, "x"), (2, "y")], t.schema)
    assert sorted((x.id, x.c) for x in catalog.replace_children(t, rows, "id").collect()) == [(1, "a"), (2, "x"), (2, "y")]
    run = spark.createDataFrame([("a", 2, "x")], "query string, rank int, candidate string")
    each = evaluation.per_query(run, spark.createDataFrame([("a", "x")], "query string, candidate string"))
    assert evaluation.legacy_mrr(each).first().mrr == 1.0 and evaluation.summary(each).first().mrr == 0.5
    assert "mrr: 0.500" in [x.line for x in evaluation.report(evaluation.summary(each)).collect()]
