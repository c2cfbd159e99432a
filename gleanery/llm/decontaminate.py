"""Benchmark decontamination by template canonicalisation.

Tokens are runs of letters and digits. In a text's template, numbers, capitalised words
(names) and units after a number become typed placeholders; windows of WINDOW template
tokens are hash-joined with those of the benchmark items. Windows of one document and
item that stand at the same distance form an alignment, and count only if their slots
are consistent: the item's values map one to one to the document's, so a question asked
again with other names and numbers is caught, and a chance likeness is not. A second
view of the same windows, lower-cased and without placeholders, catches copies whose
case was changed. A window that is the item's word for word counts on its own, whatever
was changed elsewhere in the document: only alignments without one rest on their slots.

Only document windows that a bit map of the benchmark's hashes lets through leave the
scan; its size is fixed, whatever the benchmark's. Equal windows of several items are
one row, so a passage that fills a benchmark joins once.

Defined results: null and empty texts are clean, as are null and empty items; an item of
fewer than WINDOW tokens is one window of its own length, and of fewer than SHORTEST is
not looked for; of items with the same window the smallest ``item_id`` is named; rows
that repeat a ``doc_id`` are judged each by its own text; an empty benchmark leaves all
clean; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .common import free, materialize, read, text_or_empty

WINDOW, SHORTEST, LITERALS = 13, 8, 6
BITMAP_BITS = 24
#: Units that become a placeholder after a number.
UNITS = "km m cm mm mi ft in kg g mg lb oz l ml s ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years km/h mph kb mb gb tb hz usd eur gbp dollars euros pounds percent degrees".split()

_INNER = np.zeros(256, bool)
_INNER[48:58] = _INNER[65:91] = _INNER[97:123] = _INNER[128:] = True
_GAP = np.where(_INNER, np.arange(256), 32).astype(np.uint8)
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0))


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(arrays.mix(arrays.stretch(arrays.running(data), np.array([0]), np.array([len(data)])) + np.uint64(len(data)))[0])


_UNIT_HASHES = np.sort(np.array([_hash(u) for u in UNITS if u.isalnum()], np.uint64))


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: each token's lower-cased hash, its placeholder (0 if literal), and each document's first token."""
    raw = _GAP[data]
    low = arrays.LOWER[raw]
    starts, ends, first = arrays.word_bounds(low, at)
    value = arrays.mix(arrays.stretch(arrays.running(low), starts, ends) + (ends - starts).astype(np.uint64))
    digits = np.concatenate(([0], np.cumsum((raw >= 48) & (raw <= 57))))
    number = digits[ends] - digits[starts] == ends - starts
    name = (raw[starts] >= 65) & (raw[starts] <= 90)
    after = np.concatenate(([False], number[:-1])) if len(number) else number
    unit = after & np.isin(value, _UNIT_HASHES)
    slot = np.where(number, _NUMBER, np.where(name, _NAME, np.where(unit, _UNIT, np.uint64(0))))
    return value, slot, first


def windows(value: np.ndarray, slot: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, valid) of all windows of a chunk, whatever documents they stand in: by template, and as they are."""
    n = len(value) - size + 1
    if n <= 0:
        return [(np.zeros(0, np.uint64), np.zeros(0, bool))] * 2
    p, inverse = arrays.powers(len(value) + 1)
    literal = np.concatenate(([0], np.cumsum(slot == 0)))
    out = []
    for view, x in enumerate((np.where(slot != 0, slot, value), value)):
        sums = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(x * p[: len(x)], out=sums[1:])
        h = arrays.mix((sums[size:] - sums[:-size]) * inverse[:n] + np.uint64(2 * size + view))
        enough = literal[size:] - literal[:-size] >= min(LITERALS, size // 2) if view == 0 else np.ones(n, bool)
        out.append((h, enough))
    return out


def _scan(sizes: list[int], bitmap: np.ndarray | None, whole: bool):
    """For mapInArrow: windows that the bit map holds (all without one), with place and slots.

    ``whole``: an item, for which only the window size that fits its length is taken."""

    def run(batches):
        for b in batches:
            ids, digest = b.column(0), b.column(1)
            data, at = arrays.column_bytes(b.column(2))
            for a, _, some, own in arrays.chunks(data, at):
                value, slot, first = tokens(some, own)
                length = np.diff(first)
                doc = np.repeat(np.arange(len(length)), length)
                for size in sizes:
                    for view, (h, good) in enumerate(windows(value, slot, size)):
                        if not len(h):
                            continue
                        good = good & (doc[: len(h)] == doc[size - 1 :])
                        if whole:
                            good &= np.minimum(length[doc[: len(h)]], WINDOW) == size
                        if bitmap is not None:
                            place = h >> np.uint64(64 - BITMAP_BITS)
                            good &= (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                        hit = np.flatnonzero(good)
                        if not len(hit):
                            continue
                        slots = []
                        for k in hit.tolist():
                            own_slots = np.flatnonzero(slot[k : k + size]) if view == 0 else ()
                            slots.append([int(np.int64(np.uint64(value[k + j] ^ slot[k + j]))) for j in own_slots] if view == 0 else [])
                        rows = pa.array(a + doc[hit])
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(rows),
                                digest.take(rows),
                                pa.array(hit - first[doc[hit]], pa.int64()),
                                pa.array(h[hit].astype(np.int64)),
                                pa.array(slots, pa.list_(pa.int64())),
                            ],
                            ["id", "digest", "at", "hash", "slots"],
                        )
            arrays.trim()

    return run


WINDOWS = "id long, digest long, at long, hash long, slots array<long>"


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``digest`` (of the text), ``item_id``, ``exact``: document rows' consistent alignments with items."""
    spark = docs.sparkSession
    sizes = list(range(SHORTEST, WINDOW + 1))
    items = benchmark.select("item_id", F.lit(0).cast("long").alias("digest"), "text").filter("item_id is not null")
    known = materialize(items.mapInArrow(_scan(sizes, None, True), WINDOWS).groupBy("hash", "slots").agg(F.min(F.struct("id", "at")).alias("item")), "items")
    # at most 2**(BITMAP_BITS - 3) bytes, however large the benchmark
    byte = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    marks = known.groupBy(F.shiftright(byte, 3).alias("byte")).agg(F.bit_or(F.expr(f"shiftleft(1, cast(shiftrightunsigned(hash, {64 - BITMAP_BITS}) & 7 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    bitmap[marks.column("byte").to_numpy()] = marks.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(bitmap)

    def scan(batches):
        yield from _scan(sizes, sent.value, False)(batches)

    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text_or_empty()).alias("digest"), "text")
    found = rows.mapInArrow(scan, WINDOWS).alias("d").join(known.alias("k"), F.col("d.hash") == F.col("k.hash"))
    found = found.filter(F.size("d.slots") == F.size("k.slots"))
    found = found.select("id", "digest", F.col("item.id").alias("item_id"), (F.col("at") - F.col("item.at")).alias("shift"), F.arrays_zip(F.col("k.slots").alias("i"), F.col("d.slots").alias("d")).alias("slots"))
    same = F.forall("slots", lambda s: s["i"] == s["d"])  # so of each window as it is, which has no slots
    pairs = F.array_distinct(F.flatten(F.collect_set("slots")))
    aligned = found.groupBy("id", "digest", "item_id", "shift").agg(pairs.alias("slots"), F.max(same).alias("verbatim"))
    one_to_one = (F.size(F.array_distinct("slots.i")) == F.size("slots")) & (F.size(F.array_distinct("slots.d")) == F.size("slots"))
    aligned = aligned.filter(F.col("verbatim") | one_to_one).select(F.col("id").alias("doc_id"), "digest", "item_id", same.alias("exact"))
    return aligned.groupBy("doc_id", "digest", "item_id").agg(F.max("exact").alias("exact"))


def _verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark).groupBy(F.col("doc_id").alias("m_id"), F.col("digest").alias("m_digest")).agg(
        F.count("*").alias("n_items"), F.min("item_id").alias("item_id"), F.max("exact").alias("exact")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``contaminated``, ``n_items``, ``item_id`` (the smallest matched), ``exact`` (values unchanged) for each row."""
    rows, found = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("digest")), _verdicts(docs, benchmark)
    both = rows.join(found, rows["doc_id"].eqNullSafe(found["m_id"]) & (rows["digest"] == found["m_digest"]), "left")
    return both.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_id", "exact")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item, all columns kept."""
    found = _verdicts(docs, benchmark).select("m_id", "m_digest")
    digest = free("_digest", docs.columns)
    own = docs.withColumn(digest, F.xxhash64(text_or_empty()))
    return own.join(found, own["doc_id"].eqNullSafe(found["m_id"]) & (own[digest] == found["m_digest"]), "left_anti").select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
