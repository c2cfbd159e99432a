"""Pixel, image-type and face-quality expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hue(r: Column, g: Column, b: Column) -> Column:
    """Degrees in [0, 360); 0 for greys. ``%`` keeps the dividend's sign, as the shift by 360 expects."""
    r, g, b = (x.cast("double") for x in (r, g, b))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    h = F.when(d == 0, 0.0).when(high == r, 60 * (F.try_divide(g - b, d) % 6)).when(high == g, 60 * (F.try_divide(b - r, d) + 2)).otherwise(60 * (F.try_divide(r - g, d) + 4))
    return F.when(h < 0, h + 360).otherwise(h)


def hsv_bin(r: Column, g: Column, b: Column) -> Column:
    """8 hues x 4 saturations x 2 values (above one half or not); a full saturation wraps to 0."""
    high, low = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    s = F.when(high == 0, 0.0).otherwise(F.try_divide(high - low, high))
    hb, sb, vb = F.floor(hue(r, g, b) / 45).cast("int") % 8, F.floor(s * 4).cast("int") % 4, F.when(high / 255.0 > 0.5, 1).otherwise(0)
    return hb * 8 + sb * 2 + vb


def lightness(r: Column, g: Column, b: Column) -> Column:
    return (F.greatest(r, g, b) + F.least(r, g, b)) / F.lit(510.0)


def hsl_saturation(r: Column, g: Column, b: Column) -> Column:
    """NULL for black and white, which averages leave out."""
    l, d = lightness(r, g, b), (F.greatest(r, g, b) - F.least(r, g, b)) / F.lit(255.0)
    return F.when((l > 0) & (l < 1), d / (1 - F.abs(2 * l - 1)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def packed(r: Column, g: Column, b: Column, shift: int = 0) -> Column:
    """One integer per colour, each channel shifted right by ``shift`` bits first."""
    r, g, b = (F.shiftright(x.cast("int"), shift) for x in (r, g, b))
    return F.shiftleft(r, 16) + F.shiftleft(g, 8) + b


def skin(r: Column, g: Column, b: Column) -> Column:
    return (r > g) & (r > 95) & (F.abs(r - g) < 50) & (F.abs(g - b) < 50) & (hue(r, g, b) > 0) & (hue(r, g, b) < 50) & (F.coalesce(hsl_saturation(r, g, b), F.lit(0.0)) > 0.1)


def intersection(a: Column, b: Column) -> Column:
    """Sum of the smaller bins, up to the shorter histogram."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)


def image_type(w, h, entropy, saturation, colors, variance) -> Column:
    long, short = F.greatest(w, h), F.least(w, h)
    return (
        F.when(F.least(w, h) < 256, "unknown")
        .when(long / short > 2.5, "screenshot")
        .when(entropy < 4, "anime")
        .when(saturation > 0.65, "poster")
        .when(colors < 100, "meme")
        .when((variance < 0.01) & (w != h), "screenshot")
        .otherwise("photo")
    )


def passes_filter(w, h, n_bytes, entropy) -> Column:
    """The first reason to skip an image, or NULL."""
    long, short = F.greatest(w, h), F.least(w, h)
    return F.when(short < 256, "small").when(long / short > 5, "aspect").when(F.try_divide(n_bytes, w * h) < 0.05, "bytes").when(entropy < 3.5, "entropy")


def area_score(w, h) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(w, h) / F.lit(150.0)))


def blur_score(variance) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), variance / F.lit(100.0)))


def pose_score(tilt, eye_dy) -> Column:
    one = F.lit(1.0)
    return ((one - F.least(F.abs(tilt), one)) + (one - F.least(F.abs(eye_dy) / 50.0, one))) / 2


def face_quality(detector, blur, pose) -> Column:
    return detector * 0.7 + blur * 0.0 + pose * 0.3


def face_quality_angles(detector, blur, area, yaw, pitch, roll) -> Column:
    """Weighted by detector .30, blur .25, area .25 (of 10,000 pixels), pose .20, in [0, 1]."""
    off = lambda a: F.greatest(F.abs(a) - 15, F.lit(0.0)) / 45
    pose = 1 - (off(yaw) + off(pitch) + off(roll)) / 3
    score = detector * 0.30 + blur * 0.25 + F.least(area / 10000.0, F.lit(1.0)) * 0.25 + pose * 0.20
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def reject_reason(detector, area, eyes, pose, eyes_inside=None) -> Column:
    """The first gate a face fails, in this order, or NULL; with ``eyes_inside`` the query side's stricter detector gate."""
    least = F.lit(0.3) if eyes_inside is None else F.when(eyes_inside, 0.3).otherwise(0.45)
    return F.when(detector < least, "detector").when(area < 0.15, "area").when(eyes < 12, "eyes").when(pose < 0.2, "pose")


def real_face(reasons: list[Column], score: Column) -> Column:
    n = sum((F.when(r, 1).otherwise(0) for r in reasons), F.lit(0))
    return F.when((n >= 2) | (score < 0.3), "fake").when(score > 0.6, "real").otherwise("unsure")


def bucket(score: Column, high: float = 0.8, middle: float = 0.6, strict: bool = True) -> Column:
    over = (lambda t: score > t) if strict else (lambda t: score >= t)
    return F.when(over(high), "green").when(over(middle), "yellow").otherwise("red")


def texture_ok(variance: Column) -> Column:
    return variance.between(200, 6500)


def color_variance(r: Column, g: Column, b: Column) -> Column:
    """An aggregate: the mean of the channels' variances, as a share of 255 squared."""
    return (F.var_pop(r) + F.var_pop(g) + F.var_pop(b)) / 3 / (255.0 * 255.0)
