"""Pairs of overlapping boxes against all pairs in plain Python."""

import random

import pytest

from gleanery.operators import overlap
from gleanery.plans import boxes as plans


def made(kind: str) -> list[tuple]:
    rng = random.Random(5)
    at = {"whole": lambda: rng.randint(-40, 60), "far": lambda: 10**7 + rng.randint(0, 90), "real": lambda: rng.uniform(-40, 60)}[kind]
    side = {"whole": lambda: rng.randint(0, 40), "far": lambda: rng.randint(1, 40), "real": lambda: rng.uniform(1, 40)}[kind]
    rows = [(rng.choice("ab"), k, at(), at(), side(), side()) for k in range(300)]
    rows += [(i, k // 2 + 300, x, y, w, h) for i, k, x, y, w, h in rows[:40]]  # copies, and ids that repeat
    return [*rows, (None, 900, *rows[0][2:]), ("a", None, *rows[0][2:]), ("a", 901, None, *rows[0][3:]), ("a", 902, rows[0][2], rows[0][3], 500 if kind != "real" else 500.0, rows[0][5])]


def iou(a, b) -> float:
    wide, high = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    return wide * high / (a[4] * a[5] + b[4] * b[5] - wide * high) if wide > 0 and high > 0 else 0.0


def brute(rows: list[tuple]) -> list[tuple]:
    good = [r for r in rows if None not in r]
    return [(a[0], a[1], b[1], iou(a, b)) for a in good for b in good if a[0] == b[0] and a[1] < b[1]]


@pytest.mark.parametrize("kind", ["whole", "far", "real"])
def test_counted_as_all_pairs_give(spark, kind, monkeypatch):
    monkeypatch.setattr(overlap, "ROWS", 7), monkeypatch.setattr(overlap, "COLUMNS", 16)
    t = "double" if kind == "real" else "long"
    rows = made(kind)
    want: dict = {}
    for image, a, _, v in brute(rows):
        if v > 0.4:
            want[image, a] = want.get((image, a), 0) + 1
    got = overlap.counted(spark.createDataFrame(rows, f"image string, id long, x {t}, y {t}, w {t}, h {t}"), 0.4).collect()
    assert {(r.image, r.id): r.n for r in got} == want and want


def test_duplicates_are_counted_without_a_row_for_each_pair(spark, sf):
    assert "Join" not in plans.box_duplicates(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_no_boxes(spark):
    none = spark.createDataFrame([], "image string, id long, x long, y long, w long, h long")
    assert overlap.counted(none, 0.4).count() == 0 and overlap.pairs(none, 0.3).count() == 0


@pytest.mark.parametrize("kind", ["whole", "far", "real"])
def test_pairs_are_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(overlap, "ROWS", 7), monkeypatch.setattr(overlap, "COLUMNS", 16), monkeypatch.setattr(overlap, "OUT", 50)
    t = "double" if kind == "real" else "long"
    rows = made(kind)
    want = sorted((i, a, b, round(v, 9)) for i, a, b, v in brute(rows) if v >= 0.3)
    got = overlap.pairs(spark.createDataFrame(rows, f"image string, id long, x {t}, y {t}, w {t}, h {t}"), 0.3).collect()
    assert sorted((r.image, r.id, r.id2, round(r.iou, 9)) for r in got) == want and want


def test_joined_boxes_are_not_compared_row_by_row(spark, sf):
    assert "Join" not in plans.box_iou_join(spark, sf)._jdf.queryExecution().executedPlan().toString()
