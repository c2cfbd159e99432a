"""Shared passages: which documents hold WORDS words in a row that stand in another document too.

Words are runs free of ASCII white space, taken as written; the white space between them does
not count. A window is WORDS words in a row; its anchor is its smallest GRAM-word hash, so equal
windows have equal anchors. The windows of a document that share an anchor fill a frame.

1. Anchors and frames are counted over the corpus. A frame that stands in two documents settles
   both; an anchor whose frames are all equal or all in one document settles that no other
   document has its windows.
2. Of the anchors left, one document for each frame shows its windows, which are counted.

Blocks of documents send packed hashes to buckets, of which each answers for some BUCKET_BYTES
of text. Frames and windows are told apart by 96 bits, words by 64. Defined results: null counts
as empty; matches never cross documents; rows that repeat are other documents to one another;
fewer than WORDS words share nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays, exchange
from .bpe import numbers, pack, unpack
from .common import buckets, materialize, text_or_empty

WORDS, GRAM = 51, 16
BLOCK_BYTES, BUCKET_BYTES = 16 << 20, 16 << 20
#: Documents whose windows are needed, up to this many anchors (8 bytes each), are named by a broadcast; more are shuffled.
BROADCAST_ROWS = 500_000
_CHECK, _FRAME, _WINDOW = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3))

ROWS = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
ROWS_DDL, OPEN_DDL, KEY_DDL = "bucket int, payload binary", "key long, gram long", "key long"


class Windows:
    """Of a chunk of documents: runs of windows with the same anchor, as first and last window start (counted in words)."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        starts, ends, words = arrays.word_bounds(data, at)
        self.first = self.last = self.doc = np.zeros(0, np.int64)
        self.gram = np.zeros(0, np.uint64)
        valid = arrays.ragged(words[:-1], np.maximum(np.diff(words) - WORDS + 1, 0))
        if not len(valid):
            return
        word = arrays.mix(arrays.stretch(arrays.running(data), starts, ends) + (ends - starts).astype(np.uint64))
        self.sums, self.checks = arrays.summed(word), arrays.summed(arrays.mix(word ^ _CHECK))
        place = np.arange(len(word) - GRAM + 1)
        gram = arrays.mix(arrays.stretch(self.sums, place, place + GRAM))
        best = arrays.smallest_at(gram, WORDS - GRAM + 1)[valid]
        cut = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        self.first, self.last = valid[cut], valid[np.append(cut[1:], len(valid)) - 1]
        self.gram = arrays.mix(gram[best[cut]])  # the smallest hashes are low ones: mixed again, they fill all buckets alike
        self.doc = np.searchsorted(words, self.first, "right") - 1

    def hashes(self, start: np.ndarray, end: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Hash and second hash of words [start, end)."""
        if not len(start):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        length = (end - start).astype(np.uint64)
        check = (arrays.mix(arrays.stretch(self.checks, start, end)) >> np.uint64(32)).astype(np.uint32)
        return arrays.mix(arrays.mix(arrays.stretch(self.sums, start, end) ^ salt) + length), check

    def frames(self) -> tuple[np.ndarray, ...]:
        """(document, anchor, frame, its second hash), each once."""
        return _once(self.doc, self.gram, *self.hashes(self.first, self.last + WORDS, _FRAME))

    def windows(self, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, window, its second hash), each once, of the runs whose anchor is among a document's own in ``wanted`` (by ``named``)."""
        some = np.flatnonzero(np.isin(named(self.doc, self.gram), wanted))
        n = self.last[some] - self.first[some] + 1
        start = arrays.ragged(self.first[some], n)
        return _once(np.repeat(self.doc[some], n), *self.hashes(start, start + WORDS, _WINDOW))


def named(doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """A hash of document and anchor; windows shown without need do no harm."""
    return arrays.mix(gram + doc.astype(np.uint64) * arrays.BASE)


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by ``columns``, the first one first, and where in it a group of equal ones begins."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, new


def _once(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order, new = _groups(*columns)
    return tuple(c[order[new]] for c in columns)


def _deal(parts: list[tuple[np.ndarray, ...]], n_buckets: int) -> pa.RecordBatch:
    """Packed by bucket of the second column: document keys, and the other columns."""
    key, name, *more = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(name, kind="stable")
    name, key, more = name[order], key[order], [c[order] for c in more]
    edge, rows = exchange.edges(name, n_buckets), []
    for b in np.flatnonzero(np.diff(edge)).tolist():
        own = slice(edge[b], edge[b + 1])
        rows.append((b, pack(exchange.pack_ascending(name[own]), key[own].astype("<i8").tobytes(), *[c[own] if c.dtype == np.uint32 else c[own].astype("<u8").tobytes() for c in more])))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(ROWS.types)], schema=ROWS)


def _dealt(table: pa.Table) -> tuple[list[np.ndarray], ...]:
    """A bucket's columns: names, document keys, and those that followed, as bytes."""
    rows = [unpack(p.as_py()) for p in table.column("payload")]
    joined = [[r[k] for r in rows] for k in range(len(rows[0]))]
    name = np.concatenate([exchange.unpack_ascending(x) for x in joined[0]])
    return name, np.concatenate([np.frombuffer(x, "<i8") for x in joined[1]]), *joined[2:]


def ask_frames(n_buckets: int, block_bytes: int):
    """For mapInArrow on ``key``, ``text``: every document's anchors and frames, packed by bucket of the anchor."""

    def run(batches):
        for batch in batches:
            data, at = arrays.column_bytes(batch.column("text"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for a, _, block, starts in arrays.chunks(data, at, block_bytes):
                parts = []
                for c, _, some, own in arrays.chunks(block, starts):
                    doc, *found = Windows(some, own).frames()
                    parts.append((keys[a + c + doc], *found))
                yield _deal(parts, n_buckets)
            arrays.trim()

    return run


def settle_frames(key, table):
    """For applyInArrow on a bucket: documents (``gram`` null) that have a frame another one has, and which are to show an anchor's windows."""
    gram, doc, frame, check = _dealt(table)
    frame, check = np.concatenate([np.frombuffer(x, "<u8") for x in frame]), np.concatenate([numbers(x) for x in check])
    order, first = _groups(gram, frame, check)
    gram, doc = gram[order], doc[order]
    of = np.cumsum(first) - 1
    again = np.bincount(of)[of] > 1  # a document has each frame once
    head = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(gram))))
    differ = (np.add.reduceat(first.astype(np.int64), head) > 1) & (np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head))
    settled = np.unique(doc[again])
    shown = _once(doc[first & differ[of]], gram[first & differ[of]])
    grams = pa.concat_arrays([pa.nulls(len(settled), pa.int64()), pa.array(shown[1].astype(np.int64), pa.int64())])
    return pa.table({"key": pa.array(np.concatenate((settled, shown[0])), pa.int64()), "gram": grams})


def ask_windows(n_buckets: int, block_bytes: int):
    """For mapInArrow on ``key``, ``text``, ``grams``: the windows of those anchors, packed by bucket of the window."""

    def run(batches):
        for batch in batches:
            data, at = arrays.column_bytes(batch.column("text"))
            keys, grams = batch.column("key").to_numpy(zero_copy_only=False), batch.column("grams")
            sizes = np.concatenate(([0], np.cumsum(grams.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
            values = grams.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            for a, _, block, starts in arrays.chunks(data, at, block_bytes):
                parts = []
                for c, d, some, own in arrays.chunks(block, starts):
                    edge = sizes[a + c : a + d + 1]
                    wanted = named(np.repeat(np.arange(d - c), np.diff(edge)), values[edge[0] : edge[-1]])
                    doc, *found = Windows(some, own).windows(wanted)
                    parts.append((keys[a + c + doc], *found))
                yield _deal(parts, n_buckets)
            arrays.trim()

    return run


def settle_windows(key, table):
    """For applyInArrow on a bucket: documents that have a window another one has."""
    window, doc, check = _dealt(table)
    order, first = _groups(window, np.concatenate([numbers(x) for x in check]))
    of = np.cumsum(first) - 1
    return pa.table({"key": pa.array(np.unique(doc[order][np.bincount(of)[of] > 1]), pa.int64())})


def document_key() -> Column:
    """What tells documents apart: rows with the same ``doc_id`` and text share it, and their result."""
    return F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), F.xxhash64(text_or_empty()))


def sharing_keys(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``key`` (see ``document_key``) of each document that shares a passage, once."""
    keyed, n = docs.select(document_key().alias("key"), "text"), buckets(docs, bucket_bytes)
    asked = keyed.mapInArrow(ask_frames(n, block_bytes), ROWS_DDL).repartition(n, "bucket")
    found = materialize(asked.groupBy("bucket").applyInArrow(settle_frames, OPEN_DDL), "frames")
    shown = found.filter(F.col("gram").isNotNull())
    grams = shown.groupBy("key").agg(F.collect_list("gram").alias("grams"))
    grams = F.broadcast(grams) if shown.count() <= BROADCAST_ROWS else grams
    windows = keyed.join(grams, "key").select("key", "text", "grams").mapInArrow(ask_windows(n, block_bytes), ROWS_DDL).repartition(n, "bucket")
    again = windows.groupBy("bucket").applyInArrow(settle_windows, KEY_DDL)
    return found.filter(F.col("gram").isNull()).select("key").union(again).distinct()
