"""Path, size and encoding expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that count as images in a scan, and in an index of categories.
IMAGE_EXTENSIONS = (
    "jpg", "jpeg", "png", "webp", "bmp", "gif", "tiff", "tif", "heic", "heif", "avif", "svg", "ico", "raw", "cr2", "nef",
    "arw", "dng", "orf", "rw2", "pef", "srw", "x3f", "3fr", "raf", "mrw", "nrw", "dcr", "mos", "crw", "erf", "mdc",
)
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "tiff", "tif")
#: Media types by suffix (JPEG otherwise), and suffixes by media type (jpg otherwise).
MIME = {"png": "image/png", "webp": "image/webp", "gif": "image/gif"}
SUFFIX = {"image/png": "png", "image/webp": "webp", "image/gif": "gif", "image/bmp": "bmp"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def is_image(path: Column, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def shortened(name: Column, most: int = 20) -> Column:
    return F.when(F.char_length(name) > most, F.concat(F.substring(name, 1, most - 3), F.lit("..."))).otherwise(name)


def is_crop(path: Column) -> Column:
    return path.rlike("query_crop|crop_query|cropped")


def thumbnail_path(hash_: Column) -> Column:
    """Sharded by the hash's first two characters."""
    return F.concat_ws("/", F.substring(hash_, 1, 2), F.concat(hash_, F.lit(".jpg")))


def mime(path: Column) -> Column:
    out = F.lit("image/jpeg")
    for e, m in MIME.items():
        out = F.when(extension(path) == e, m).otherwise(out)
    return out


def suffix(media_type: Column) -> Column:
    out = F.lit("jpg")
    for m, e in SUFFIX.items():
        out = F.when(media_type == m, e).otherwise(out)
    return out


def data_url(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime(path), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def human_size(n: Column) -> Column:
    """B without decimals, KB, MB and GB with two."""
    k, m, g = 1024.0, 1024.0**2, 1024.0**3
    return F.when(n >= g, F.format_string("%.2f GB", n / F.lit(g))).when(n >= m, F.format_string("%.2f MB", n / F.lit(m))).when(n >= k, F.format_string("%.2f KB", n / F.lit(k))).otherwise(F.format_string("%d B", n.cast("long")))


def short_number(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / F.lit(1e6))).when(n >= 1000, F.format_string("%.1fK", n / F.lit(1e3))).otherwise(n.cast("string"))


def fixed(s: Column, size: int) -> Column:
    """Padded with NUL characters to ``size``, longer ones cut."""
    return F.rpad(s, size, "\0")


def unfixed(s: Column) -> Column:
    return F.rtrim(s, F.lit("\0"))


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100.0)
