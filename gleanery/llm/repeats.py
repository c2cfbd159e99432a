"""Repeated passages: removes bytes covered by a LENGTH-byte string that also starts elsewhere.

Every window of LENGTH bytes has an anchor, its smallest GRAM-byte hash, so equal windows
have equal anchors at equal offsets. The offsets come in sections of SECTION; all windows
of a section share a core of bytes around the anchor and lie within a frame.

1. Anchors are counted over the corpus; only documents with one that occurs again go on.
2. Cores and frames are counted. A frame that occurs again settles its whole section, a
   core that does not settles that none of its windows repeats.
3. What is left are sections at the edges of repeated passages. Their shards, by core,
   are strings in which the core is one symbol between the few bytes before and after
   it; a window is a substring of SECTION symbols. Suffix arrays of the shards by induced
   sorting, and permuted common prefixes, tell which windows repeat. A core of more than
   HOT places is not gathered into one shard: its windows are counted by their hashes.

Blocks of documents send distinct hashes and counts and get totals back, so that a
passage in a third of all documents is one entry per block. Cores, frames and windows
are told apart by 96 bits (two hashes). The number of buckets follows the bytes that
go on, so that each answers for some BUCKET_BYTES of text. Defined results: null counts
as empty; texts under LENGTH bytes lose nothing; matches never cross documents, overlaps
within one count; rows that repeat are elsewhere to one another; null ids are kept; an
empty table gives no rows; other columns are not read.

A passage of over 50 words is often shorter than LENGTH bytes and loses nothing then. Which
documents hold one that stands in another document too is told beside the removals (``passages``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, exchange, passages, suffix_array
from .bpe import numbers, pack, unpack
from .common import buckets, materialize, read, text_or_empty

LENGTH, GRAM, SECTION = 400, 64, 20
HOT = 2000
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Keys of documents up to this count (16 bytes each) are broadcast; more are shuffled.
BROADCAST_ROWS = 500_000
GRAMS = LENGTH - GRAM + 1
_CORE, _FRAME, _WINDOW = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))

ROWS = pa.schema([("place", pa.string()), ("block", pa.string()), ("bucket", pa.int32()), ("payload", pa.binary())])
ROWS_DDL, BACK_DDL = "place string, block string, bucket int, payload binary", "block string, bucket int, payload binary"


class Anchors:
    """Of a chunk of documents: each anchor with the window starts it stands for."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at
        self.sums, self.checks = arrays.running(data), arrays.running(data, arrays.CHECK)
        n = len(data)
        self.anchor = self.first = self.last = self.doc = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        place = np.arange(n - GRAM + 1)
        gram = arrays.mix(arrays.stretch(self.sums, place, place + GRAM))
        best = arrays.smallest_at(gram, GRAMS)
        length = np.diff(at)
        valid = arrays.ragged(at[:-1], np.maximum(length - LENGTH + 1, 0))
        if not len(valid):
            return
        best = best[valid]
        cut = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        self.anchor, self.first, self.last = best[cut], valid[cut], valid[np.append(cut[1:], len(valid)) - 1]
        self.doc = np.searchsorted(at, self.anchor, "right") - 1
        self.hash = gram[self.anchor]

    def sections(self) -> None:
        """For each anchor and section of its offsets: the keys of core and frame (0: beyond the document)."""
        low, high = (self.anchor - self.last) // SECTION, (self.anchor - self.first) // SECTION
        self.of = np.repeat(np.arange(len(self.anchor)), high - low + 1)
        self.section = arrays.ragged(low, high - low + 1)
        a = self.anchor[self.of]
        near, far = self.section * SECTION, self.section * SECTION + SECTION - 1
        self.core_start, self.core_end = a - near, a - far + LENGTH
        self.frame_start, self.frame_end = a - far, a - near + LENGTH
        mark = self.hash[self.of] + self.section.astype(np.uint64)
        self.core = arrays.mix(arrays.mix(arrays.stretch(self.sums, self.core_start, self.core_end) ^ _CORE) + mark)
        d = self.doc[self.of]
        whole = (self.frame_start >= self.at[d]) & (self.frame_end <= self.at[d + 1])
        self.frame = np.zeros(len(a), np.uint64)
        self.core_check = self.check(self.core_start, self.core_end)
        w = np.flatnonzero(whole)
        self.frame_check = self.check(self.frame_start[w], self.frame_end[w])
        self.frame[w] = arrays.mix(arrays.mix(arrays.stretch(self.sums, self.frame_start[w], self.frame_end[w]) ^ _FRAME) + mark[w])

    def windows_of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The window starts of some sections, and the section (as a number among ``some``) of each."""
        a, k = self.of[some], self.section[some]
        first = np.maximum(self.first[a], self.anchor[a] - k * SECTION - SECTION + 1)
        last = np.minimum(self.last[a], self.anchor[a] - k * SECTION)
        n = last - first + 1
        return arrays.ragged(first, n), np.repeat(np.arange(len(some)), n)

    def check(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A second hash of stretches."""
        return (arrays.mix(arrays.stretch(self.checks, start, end)) >> np.uint64(32)).astype(np.uint32)

    def window_keys(self, starts: np.ndarray) -> np.ndarray:
        return arrays.mix(arrays.stretch(self.sums, starts, starts + LENGTH) ^ _WINDOW)

    def window_checks(self, starts: np.ndarray) -> np.ndarray:
        return self.check(starts, starts + LENGTH)


def anchor_counts(batches):
    """For mapInArrow: (anchor hash, document key, times) for each distinct anchor of a document."""
    for b in batches:
        data, at = arrays.column_bytes(b.column("text"))
        for a, _, some, own in arrays.chunks(data, at):
            x = Anchors(some, own)
            if not len(x.anchor):
                continue
            order = np.lexsort((x.hash, x.doc))
            h, d = x.hash[order], x.doc[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
            times = np.diff(np.append(new, len(h)))
            rows = pa.array(a + d[new])
            yield pa.RecordBatch.from_arrays([pa.array(h[new].astype(np.int64)), b.column("key").take(rows), pa.array(times, pa.int64())], ["hash", "key", "times"])


class Own:
    """A block's documents, in one row that travels with it."""

    @staticmethod
    def packed(ids: pa.Array, digests: pa.Array, data: np.ndarray, at: np.ndarray) -> bytes:
        known = np.array(ids.is_valid().to_pylist(), np.uint8)
        return pack(np.diff(at), known.tobytes(), np.array(ids.fill_null(0).to_pylist(), "<i8").tobytes(), np.array(digests.to_pylist(), "<i8").tobytes(), zstandard.ZstdCompressor(level=3).compress(data.tobytes()))

    def __init__(self, payload: bytes):
        lengths, known, ids, digests, data = unpack(payload)
        self.at = np.concatenate(([0], np.cumsum(numbers(lengths).astype(np.int64))))
        self.ids = pa.array(np.frombuffer(ids, "<i8"), mask=~np.frombuffer(known, np.uint8).astype(bool))
        self.digests = pa.array(np.frombuffer(digests, "<i8"))
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)

    def chunks(self):
        for a, b, some, own in arrays.chunks(self.data, self.at):
            x = Anchors(some, own)
            x.sections()
            yield a, b, x


class Asked:
    """Distinct hashes in order, as sent to the buckets and answered; a second hash goes with each."""

    def __init__(self, hashes: np.ndarray, checks: np.ndarray, n_buckets: int):
        self.key, index, self.back, self.count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        self.check = checks[index]
        self.edge = exchange.edges(self.key, n_buckets)

    def part(self, b: int) -> tuple[bytes, np.ndarray, np.ndarray]:
        own = slice(self.edge[b], self.edge[b + 1])
        return exchange.pack_ascending(self.key[own]), self.check[own], self.count[own]

    def answered(self, totals: list[np.ndarray]) -> np.ndarray:
        """For each hash asked, how often it occurs."""
        return np.concatenate([np.zeros(0, np.int64), *totals])[self.back]


def _totals(asked: list[tuple[bytes, bytes, bytes]]) -> list[np.ndarray]:
    """For each block's part: how often each of its hashes occurs in all."""
    own = [exchange.unpack_ascending(x[0]) for x in asked]
    at = exchange.named(np.concatenate(own), np.concatenate([numbers(x[1]) for x in asked]))
    totals = np.bincount(at, np.concatenate([numbers(x[2]) for x in asked])).astype(np.int64)
    return np.split(totals[at], np.cumsum([len(x) for x in own])[:-1])


def _joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ROWS.types, strict=True)], schema=ROWS)


def ask_sections(n_buckets: int, block_bytes: int):
    """For mapInArrow: blocks' own rows, and cores and frames to be counted."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, at = arrays.column_bytes(batch.column("text"))
            for a, b, some, own in arrays.chunks(data, at, block_bytes):
                name, seq = f"{part}-{seq}", seq + 1
                payload = Own.packed(batch.column("doc_id").slice(a, b - a), batch.column("digest").slice(a, b - a), some, own)
                rows = [("d" + name, name, -1, payload)]
                asked = _section_keys(Own(payload), n_buckets)
                for k in np.flatnonzero(np.diff(asked.edge)).tolist():
                    rows.append((f"b{k}", name, k, pack(*asked.part(k))))
                yield _rows(rows)

    return run


def _section_keys(own: Own, n_buckets: int) -> Asked:
    hashes, checks = [], []
    for _, _, x in own.chunks():
        hashes += [x.core, x.frame[x.frame != 0]]
        checks += [x.core_check, x.frame_check]
    return Asked(_joined(hashes), _joined(checks, np.uint32), n_buckets)


def count_keys(key, table):
    """For applyInArrow: a bucket's hashes are totalled and each block answered; blocks' own rows pass."""
    if not key[0].as_py().startswith("b"):
        return table.drop_columns(["place"])
    parts = _totals([unpack(p.as_py()) for p in table.column("payload")])
    return table.drop_columns(["place", "payload"]).append_column("payload", pa.array([pack(np.minimum(x, 2**32 - 1)) for x in parts], pa.binary()))


def _settle(own: Own, asked: Asked, totals: list[np.ndarray], most: int):
    """Chunk by chunk: (documents, anchors, window starts known to repeat, sections for the shards, sections for counting)."""
    n, at = asked.answered(totals), 0
    for a, b, x in own.chunks():
        core, at = n[at : at + len(x.core)], at + len(x.core)
        framed = np.flatnonzero(x.frame)
        frame = np.zeros(len(x.frame), np.int64)
        frame[framed], at = n[at : at + len(framed)], at + len(framed)
        again = np.flatnonzero(frame > 1)
        unclear = (frame < 2) & (core > 1)
        # a settled section whose core has other frames too is shown to them, once for each frame
        shown = again[core[again] > frame[again]]
        unclear[shown[np.unique(x.frame[shown], return_index=True)[1]]] = True
        yield a, b, x, x.windows_of(again)[0], np.flatnonzero(unclear & (core <= most)), np.flatnonzero(unclear & (core > most))


def _answers(table, parts: int) -> tuple[bytes, list[list[bytes]]]:
    by_bucket = np.argsort(table.column("bucket").to_numpy(), kind="stable").tolist()
    rows = [unpack(table.column("payload")[k].as_py()) for k in by_bucket[1:]]
    return table.column("payload")[by_bucket[0]].as_py(), [[r[k] for r in rows] for k in range(parts)]


def _edges(x: Anchors, some: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and lengths of the bytes before and after the cores of some sections."""
    d = x.doc[x.of[some]]
    before = np.maximum(x.frame_start[some], x.at[d])
    after = np.minimum(x.frame_end[some], x.at[d + 1])
    return before, x.core_start[some] - before, x.core_end[some], after - x.core_end[some]


def ask_edges(n_buckets: int, most: int):
    """For applyInArrow on a block with its totals: its own row with those, and what is still unclear, by core or window."""

    def run(key, table):
        payload, (packed,) = _answers(table, 1)
        own, name = Own(payload), key[0].as_py()
        totals = [numbers(p).astype(np.int64) for p in packed]
        asked = _section_keys(own, n_buckets)
        cores, core_checks, window_keys, window_checks, texts, sizes = [], [], [], [], [], []
        for _, _, x, _, shard, hot in _settle(own, asked, totals, most):
            cores.append(x.core[shard])
            core_checks.append(x.core_check[shard])
            window_keys.append(x.window_keys(x.windows_of(hot)[0]))
            window_checks.append(x.window_checks(x.windows_of(hot)[0]))
            for start, length, size_at in zip(_edges(x, shard)[0::2], _edges(x, shard)[1::2], (0, 1), strict=True):
                sizes.append((size_at, length))
                texts.append((size_at, x.data[arrays.ragged(start, length)]))
        core, check, windows = _joined(cores), _joined(core_checks, np.uint32), Asked(_joined(window_keys), _joined(window_checks, np.uint32), n_buckets)
        rows = [("d" + name, name, -1, pack(payload, np.concatenate([np.zeros(0, np.int64), *totals])))]
        bucket = exchange.bucket(core, n_buckets)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        side = []
        for k in (0, 1):
            length = np.concatenate([np.zeros(0, np.int64), *[s for j, s in sizes if j == k]])
            side.append((length, np.cumsum(length) - length, np.concatenate([np.zeros(0, np.uint8), *[t for j, t in texts if j == k]])))
        for b in np.flatnonzero(np.diff(edge) + np.diff(windows.edge)).tolist():
            some = order[edge[b] : edge[b + 1]]
            parts = [core[some].astype("<u8").tobytes(), check[some]]
            for length, start, text in side:
                parts += [length[some], text[arrays.ragged(start[some], length[some])].tobytes()]
            rows.append((f"b{b}", name, b, pack(*parts, *windows.part(b))))
        return pa.Table.from_batches([_rows(rows)])

    return run


def sort_shard(name: np.ndarray, before: list[bytes], after: list[bytes]) -> np.ndarray:
    """For each place (``name``: the number) of a core: a bit for each offset of the section whose window also stands at another place.

    The shard's string holds, place by place, the bytes before the core, the core's own
    symbol, the bytes after it, and a separator."""
    if not len(name):
        return np.zeros(0, np.int64)
    string, middle = [], []
    for c, x, y in zip(name.tolist(), before, after, strict=True):
        string += [k + 2 for k in x]
        middle.append(len(string))
        string.append(258 + c)
        string += [k + 2 for k in y]
        string.append(1)
    string.append(0)
    again = suffix_array.repeated(string, 259 + int(name.max()), SECTION)
    middle, n, m = np.array(middle), np.array([len(x) for x in before]), np.array([len(y) for y in after])
    out = np.zeros(len(name), np.int64)
    for t in range(SECTION):  # t bytes before the core, SECTION - 1 - t after
        fits = (n >= t) & (m >= SECTION - 1 - t)
        out |= np.where(fits & again[np.where(fits, middle - t, 0)], 1 << t, 0)
    return out


def sort_shards(key, table):
    """For applyInArrow: a bucket's shard is sorted and its windows counted, and each block answered; blocks' own rows pass."""
    if not key[0].as_py().startswith("b"):
        return table.drop_columns(["place"])
    asked = [unpack(p.as_py()) for p in table.column("payload")]
    core = [np.frombuffer(x[0], "<u8").astype(np.uint64) for x in asked]

    def split(x, k):
        ends, text = np.cumsum(numbers(x[k]).astype(np.int64)).tolist(), x[k + 1]
        return [text[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)] if ends else []

    before, after = ([y for x in asked for y in split(x, k)] for k in (2, 4))
    name = exchange.named(_joined(core), _joined([numbers(x[1]) for x in asked], np.uint32))
    bits = np.split(sort_shard(name, before, after), np.cumsum([len(x) for x in core])[:-1])
    parts = _totals([x[6:] for x in asked])
    payload = [pack(b, np.minimum(t, 2)) for b, t in zip(bits, parts, strict=True)]
    return table.drop_columns(["place", "payload"]).append_column("payload", pa.array(payload, pa.binary()))


def remove(n_buckets: int, most: int):
    """For applyInArrow on a block: what its documents lose, and the digest of what they keep."""

    def run(key, table):
        payload, (bits, counted) = _answers(table, 2)
        payload, totals = unpack(payload)
        own = Own(payload)
        settled = list(_settle(own, _section_keys(own, n_buckets), [numbers(totals).astype(np.int64)], most))
        core = _joined([x.core[shard] for _, _, x, _, shard, _ in settled])
        order = np.argsort(exchange.bucket(core, n_buckets), kind="stable")
        mask = np.zeros(len(core), np.int64)
        mask[order] = np.concatenate([np.zeros(0, np.int64), *[numbers(b).astype(np.int64) for b in bits]])
        starts = [(x, x.windows_of(hot)[0]) for _, _, x, _, _, hot in settled]
        windows = Asked(_joined([x.window_keys(w) for x, w in starts]), _joined([x.window_checks(w) for x, w in starts], np.uint32), n_buckets)
        times = windows.answered([numbers(c).astype(np.int64) for c in counted])
        n_removed, n_spans, digests, shard_at, hot_at = [], [], [], 0, 0
        for a, b, x, known, shard, hot in settled:
            starts, of = x.windows_of(shard)
            offset = (x.core_start[shard][of] - starts)  # bytes of the window before the core
            own_mask, shard_at = mask[shard_at : shard_at + len(shard)], shard_at + len(shard)
            edge = starts[(own_mask[of] >> offset & 1).astype(bool)]
            counted_starts = x.windows_of(hot)[0]
            own_times, hot_at = times[hot_at : hot_at + len(counted_starts)], hot_at + len(counted_starts)
            every = np.concatenate((known, edge, counted_starts[own_times > 1]))
            cover = np.zeros(len(x.data) + 1, np.int64)
            np.add.at(cover, every, 1)
            np.add.at(cover, every + LENGTH, -1)
            cover = np.cumsum(cover[:-1]) > 0
            begins = cover & ~np.concatenate(([False], cover[:-1]))
            begins[x.at[:-1][x.at[:-1] < len(cover)]] |= cover[x.at[:-1][x.at[:-1] < len(cover)]]
            removed, spans = np.concatenate(([0], np.cumsum(cover))), np.concatenate(([0], np.cumsum(begins)))
            n_removed.append(removed[x.at[1:]] - removed[x.at[:-1]])
            n_spans.append(spans[x.at[1:]] - spans[x.at[:-1]])
            for s, e in zip(x.at[:-1].tolist(), x.at[1:].tolist(), strict=True):
                digests.append(hashlib.sha256(x.data[s:e][~cover[s:e]].tobytes()).hexdigest())
        return pa.table(
            {
                "doc_id": own.ids,
                "digest": own.digests,
                "n_removed": pa.array(_joined(n_removed, np.int64)),
                "n_spans": pa.array(_joined(n_spans, np.int64)),
                "kept_sha256": pa.array(digests, pa.string()),
            }
        )

    return run


def remove_repeats(docs: DataFrame, most: int = HOT, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``shares_passage`` (see ``passages``) for each row.

    ``most``: places of a core that one shard takes. The other two bound what a task holds."""
    digest = F.xxhash64(text_or_empty())
    rows = docs.select("doc_id", digest.alias("digest"), "text")
    keyed = rows.withColumn("key", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "digest"))
    anchors = materialize(keyed.select("key", "text").mapInArrow(anchor_counts, "hash long, key long, times long"), "anchors")
    again = anchors.groupBy("hash").agg(F.sum("times").alias("n")).filter("n > 1").select("hash")
    alive = materialize(anchors.join(again, "hash", "left_semi").select("key").distinct(), "alive")
    alive = F.broadcast(alive) if alive.count() <= BROADCAST_ROWS else alive
    texts = materialize(keyed.join(alive, "key", "left_semi").select("doc_id", "digest", "text"), "texts")

    n = buckets(texts, bucket_bytes)
    asked = texts.mapInArrow(ask_sections(n, block_bytes), ROWS_DDL).repartition(n, "place")
    counted = asked.groupBy("place").applyInArrow(count_keys, BACK_DDL)
    unclear = counted.groupBy("block").applyInArrow(ask_edges(n, most), ROWS_DDL).repartition(n, "place")
    sorted_ = unclear.groupBy("place").applyInArrow(sort_shards, BACK_DDL)
    done = sorted_.groupBy("block").applyInArrow(remove(n, most), "doc_id long, digest long, n_removed long, n_spans long, kept_sha256 string")
    done = done.filter("n_removed > 0").dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest"), "n_removed", "n_spans", "kept_sha256")
    text = text_or_empty()
    own = docs.select("doc_id", digest.alias("digest"), passages.document_key().alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own"))
    both = own.join(done, own["doc_id"].eqNullSafe(done["r_id"]) & (own["digest"] == done["r_digest"]), "left")
    both = both.join(passages.sharing_keys(docs).withColumn("shared", F.lit(True)), "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")]
    return both.select("doc_id", "n_bytes", *counts, F.coalesce("kept_sha256", "own").alias("kept_sha256"), F.coalesce("shared", F.lit(False)).alias("shares_passage"))


def op5_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
