"""Boxes, letterboxing, detector decoding and sliding windows as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def iou_xywh(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    """0 without a strict overlap or where the union is empty."""
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    inter = F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0))
    union = aw * ah + bw * bh - inter
    return F.when((inter > 0) & (union > 0), inter.cast("double") / union).otherwise(0.0)


def iou_corners(a: Column, b: Column) -> Column:
    """Structs of x1, y1, x2, y2; sides are clamped at 0."""
    zero = F.lit(0.0)
    inter = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), zero) * F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), zero)
    return F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), zero)


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def corners(x, y, w, h) -> Column:
    return F.struct(*[v.cast("double").alias(n) for n, v in (("x1", x), ("y1", y), ("x2", x + w), ("y2", y + h))])


def letterbox(w: Column, h: Column, side: int = 640) -> dict[str, Column]:
    """Scale, truncated size and whole-pixel padding that fit an image into a square."""
    scale = F.least(F.lit(float(side)) / w, F.lit(float(side)) / h)
    nw, nh = (w * scale).cast("int"), (h * scale).cast("int")
    return {"scale": scale, "new_w": nw, "new_h": nh, "pad_x": F.floor((F.lit(side) - nw) / 2).cast("int"), "pad_y": F.floor((F.lit(side) - nh) / 2).cast("int")}


def unletterbox(v: Column, pad: Column, scale: Column) -> Column:
    return (v - pad) / scale


def anchor(index: Column, stride: int, side: int = 640, per_cell: int = 2) -> tuple[Column, Column]:
    """Centre of the anchor that a flat score index belongs to."""
    cells = side // stride
    cell = F.floor(index / per_cell)
    return (cell % cells) * stride, F.floor(cell / cells) * stride


def anchor_box(cx, cy, left, top, right, bottom, stride: int) -> tuple[Column, ...]:
    return cx - left * stride, cy - top * stride, cx + right * stride, cy + bottom * stride


def centre_box(cx, cy, w, h, scale_x, scale_y, width, height) -> tuple[Column, ...]:
    """Centre and size to corners, scaled and clipped to the image."""
    zero = F.lit(0.0)
    x = [F.least(F.greatest(v * scale_x, zero), width) for v in (cx - w / 2, cx + w / 2)]
    y = [F.least(F.greatest(v * scale_y, zero), height) for v in (cy - h / 2, cy + h / 2)]
    return x[0], y[0], x[1], y[1]


def clamp_box(x, y, w, h, width, height) -> tuple[Column, ...]:
    """Within the image, each side at least 1."""
    left, top = F.greatest(F.lit(0), F.least(x, width - 1)), F.greatest(F.lit(0), F.least(y, height - 1))
    return left, top, F.greatest(F.lit(1), F.least(w, width - left)), F.greatest(F.lit(1), F.least(h, height - top))


def resized(w: Column, h: Column, target: int = 256) -> tuple[Column, Column]:
    """The longest side becomes ``target`` (also when that is larger)."""
    scale = F.lit(float(target)) / F.greatest(w, h)
    return (w * scale).cast("int"), (h * scale).cast("int")


def eye_score(score: Column, x1, y1, x2, y2, eyes: list[tuple[Column, Column]], margin: int = 50) -> Column:
    """0.7 of the score where an eye lies further than ``margin`` outside the box."""
    inside = F.lit(True)
    for x, y in eyes:
        inside = inside & x.between(x1 - margin, x2 + margin) & y.between(y1 - margin, y2 + margin)
    return F.when(inside, score).otherwise(score * 0.7)


def similarity_transform(src: list[tuple[Column, Column]], dst: list[tuple[float, float]]) -> dict[str, Column]:
    """Least-squares rotation, scale and shift between five points: (x, y) -> (a x - b y + tx, b x + a y + ty)."""
    n = float(len(src))
    mx, my = sum((p[0] for p in src[1:]), src[0][0]) / n, sum((p[1] for p in src[1:]), src[0][1]) / n
    ux, uy = sum(p[0] for p in dst) / n, sum(p[1] for p in dst) / n
    num_a, num_b, den = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for (x, y), (u, v) in zip(src, dst, strict=True):
        dx, dy, du, dv = x - mx, y - my, u - ux, v - uy
        num_a, num_b, den = num_a + dx * du + dy * dv, num_b + dx * dv - dy * du, den + dx * dx + dy * dy
    a, b = F.coalesce(F.try_divide(num_a, den), F.lit(1.0)), F.coalesce(F.try_divide(num_b, den), F.lit(0.0))
    return {"a": a, "b": b, "tx": F.lit(ux) - (a * mx - b * my), "ty": F.lit(uy) - (b * mx + a * my)}


def tiles(w: Column, h: Column, size: int = 512, stride: int = 256, least: int = 10) -> Column:
    """Array of struct(x, y, w, h): windows clipped at the edge, row by row; those with a side under ``least`` are left out."""
    xs = F.sequence(F.lit(0), F.greatest(w - 1, F.lit(0)).cast("int"), F.lit(stride))
    ys = F.sequence(F.lit(0), F.greatest(h - 1, F.lit(0)).cast("int"), F.lit(stride))

    def tile(x, y):
        return F.struct(x.alias("x"), y.alias("y"), F.least(F.lit(size), w - x).alias("w"), F.least(F.lit(size), h - y).alias("h"))

    return F.filter(F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: tile(x, y)))), lambda t: (t["w"] >= least) & (t["h"] >= least))


def windows_at(w: Column, h: Column, scale: float, least: int = 32, most: Column | None = None) -> Column:
    """Array of struct(x, y, w, h): windows of a share of the image, half overlapping, row by row; the first ``most`` if given."""
    ww, hh = (w * scale).cast("int"), (h * scale).cast("int")
    sx, sy = F.greatest((ww / 2).cast("int"), F.lit(1)), F.greatest((hh / 2).cast("int"), F.lit(1))
    nx = F.floor(F.greatest(w - ww, F.lit(0)) / sx).cast("int") + 1
    ny = F.floor(F.greatest(h - hh, F.lit(0)) / sy).cast("int") + 1
    n = nx * ny if most is None else F.least(nx * ny, most)

    def window(k):
        return F.struct((k % nx * sx).alias("x"), (F.floor(k / nx).cast("int") * sy).alias("y"), ww.alias("w"), hh.alias("h"))

    every = F.transform(F.sequence(F.lit(0), n - 1), window)
    return F.when((ww >= least) & (hh >= least) & (n > 0), every).otherwise(F.array().cast("array<struct<x:int,y:int,w:int,h:int>>"))


def crop_pixels(x1, y1, x2, y2, width: Column, height: Column) -> tuple[Column, ...]:
    """A box in shares of the image to whole pixels (x, y, w, h), within the image and at least one pixel wide and high."""
    left, top = F.least((x1 * width).cast("int"), width - 1), F.least((y1 * height).cast("int"), height - 1)
    w, h = F.least((x2 * width).cast("int"), width) - left, F.least((y2 * height).cast("int"), height) - top
    return left, top, F.greatest(w, F.lit(1)), F.greatest(h, F.lit(1))


def eye_distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def spatial_variance(x: Column, y: Column) -> Column:
    """An aggregate: the mean squared distance to the mean point."""
    return F.var_pop(x) + F.var_pop(y)
