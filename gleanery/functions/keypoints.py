"""Keypoints, class scores and face alignment as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The five landmarks that faces are aligned to (left eye, right eye, nose, left and right mouth corner).
LANDMARKS = ((38.2946, 51.6968), (58.2946, 51.6968), (50.2946, 87.0256), (41.5493, 107.3550), (61.7299, 107.3550))


def landmarks(scale: float = 1.0, y_offset: float = 0.0) -> list[tuple[float, float]]:
    return [(x * scale, y * scale + y_offset) for x, y in LANDMARKS]


def normalized(flat: Column, w: Column, h: Column) -> Column:
    """[x, y, x, y, ...] in pixels to [-1, 1]."""
    return F.transform(flat, lambda k, i: 2 * k.cast("double") / F.when(i % 2 == 0, w).otherwise(h) - 1)


def in_image(flat: Column, box: Column, w: Column, h: Column, size: int = 256) -> Column:
    """Keypoints of a patch resized to ``size`` to shares of the whole image; ``box`` has x, y, w, h in pixels."""
    return F.transform(flat, lambda k, i: F.when(i % 2 == 0, (box["x"] + k.cast("double") / size * box["w"]) / w).otherwise((box["y"] + k.cast("double") / size * box["h"]) / h))


def shifted(flat: Column, dx: Column, dy: Column, scale: Column) -> Column:
    return F.transform(flat, lambda k, i: (k.cast("double") + F.when(i % 2 == 0, dx).otherwise(dy)) * scale)


def strongest(points: Column, most: int) -> Column:
    """Of an array of structs with ``score``: as it is up to ``most``, else the best, ties in order."""
    keyed = F.transform(points, lambda p, i: F.struct((-p["score"]).alias("a"), i.alias("b"), p.alias("p")))
    return F.when(F.size(points) <= most, points).otherwise(F.transform(F.slice(F.array_sort(keyed), 1, most), lambda x: x["p"]))


def best_class(scores: Column) -> Column:
    """struct(class, score) of the first largest; class 0 with 0.0 where nothing is above 0."""
    top = F.array_max(scores)
    return F.when(top > 0, F.struct((F.array_position(scores, top) - 1).cast("int").alias("class"), top.alias("score"))).otherwise(F.struct(F.lit(0).alias("class"), F.lit(0.0).cast("double").alias("score")))


def in_ellipse(x: Column, y: Column, side: int = 112) -> Column:
    """Within the mask of an aligned face: radii .40 and .48 of the side, the centre three pixels above the middle."""
    dx, dy = (x - side / 2) / (side * 0.40), (y - (side / 2 - 3)) / (side * 0.48)
    return dx * dx + dy * dy <= 1


def alignment_score(coverage: Column, spread: Column) -> Column:
    return coverage * 0.7 + spread / 255.0 * 0.3
