"""Byte-level BPE, each distinct word of the corpus encoded once.

The corpus is cut into blocks of whole documents. Per block, every document's
pre-tokens become positions in the block's own list of distinct words; the words go to
buckets by hash, so that all blocks' copies of a word meet, the word is encoded once,
and each block gets its ids back in the order it sent the words. Documents are then
reassembled by position. A word that makes up a third of the corpus is one entry per
block; a document, however long, is one row of packed positions. Decoding joins ids
with the token-byte table, which is bounded by the vocabulary file. The number of
buckets follows the table's bytes: a bucket has the words of some BUCKET_BYTES of text.

Blocks are named by scan partition and number, so that a task repeated after a lost
executor names them alike. Defined results: null counts as empty and
gives no ids; repeated rows get the same ids each; null ids are kept; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import arrays
from .common import batch_bytes, buckets, read

BLOCK_BYTES, BUCKET_BYTES = 14 << 20, 12 << 20
#: ``place`` is where a row goes first: a bucket, or for a block's own row (bucket -1) anywhere.
ROWS = pa.schema([("place", pa.string()), ("block", pa.string()), ("bucket", pa.int32()), ("payload", pa.binary())])
ROWS_DDL, BACK_DDL = "place string, block string, bucket int, payload binary", "block string, bucket int, payload binary"


def pack(*parts: np.ndarray | bytes) -> bytes:
    """Each part's length and bytes, compressed; 32-bit numbers by byte plane, as their high bytes hardly vary."""
    raw = []
    for p in parts:
        if isinstance(p, np.ndarray):
            p = np.ascontiguousarray(p.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()
        raw += [len(p).to_bytes(8, "little"), p]
    return zstandard.ZstdCompressor(level=6).compress(b"".join(raw))


def unpack(data: bytes) -> list[bytes]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


class Places(dict):
    """Gives each new word the next number."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def cut(pattern: str, n_buckets: int, block_bytes: int):
    """For mapInArrow: each block of documents as one row of its own, and requests to buckets."""
    import regex

    split = regex.compile(pattern).findall

    def block(name: str, ids: pa.Array, texts: list) -> pa.RecordBatch:
        places, docs = Places(), []
        for t in texts:
            words = split(t) if t else []
            docs.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
        at = np.concatenate(docs)
        order = np.argsort(-np.bincount(at, minlength=len(places)), kind="stable")  # frequent words get small numbers, which pack well
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        words = [w.encode("utf-8") for w in places]
        words = [words[k] for k in order.tolist()]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data, starts = np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum(sizes)))
        bucket = np.zeros(len(words), np.int64)
        for a, b, some, own in arrays.chunks(data, starts):
            bucket[a:b] = arrays.mix(arrays.stretch(arrays.running(some), own[:-1], own[1:])) % np.uint64(n_buckets)
        known = np.array(ids.is_valid().to_pylist(), np.uint8)
        numbered = np.array(ids.fill_null(0).to_pylist(), "<i8")
        rows = [("d" + name, name, -1, pack(bucket, np.array([len(d) for d in docs]), rank[at], known.tobytes(), numbered.tobytes()))]
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[b] : edges[b + 1]]
            rows.append((f"b{b}", name, b, pack(sizes[own], b"".join([words[k] for k in own.tolist()]))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ROWS.types, strict=True)], schema=ROWS)

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            text = batch.column("text")
            _, at = arrays.column_bytes(text)
            first = 0
            while first < len(text):
                past = max(first + 1, int(np.searchsorted(at, at[first] + block_bytes, "right")) - 1)
                yield block(f"{part}-{seq}", batch.column("doc_id").slice(first, past - first), text.slice(first, past - first).to_pylist())
                first, seq = past, seq + 1
                arrays.trim()

    return run


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary


def answer(path: str, pattern: str):
    """For applyInArrow: a bucket's distinct words are encoded and each block answered in its own order; blocks' own rows pass."""

    def run(key, table):
        if not key[0].as_py().startswith("b"):
            return table.drop_columns(["place"])
        encode, known, payloads = encoder(path, pattern), {}, []
        for data in table.column("payload"):
            sizes, blob = unpack(data.as_py())
            ids, at = [], 0
            for end in np.cumsum(numbers(sizes)).tolist():
                word = blob[at:end]
                got = known.get(word)
                if got is None:
                    got = known[word] = encode(word.decode("utf-8"))
                ids.append(got)
                at = end
            flat = np.fromiter((x for got in ids for x in got), np.uint32)
            payloads.append(pack(np.fromiter(map(len, ids), np.uint32, len(ids)), flat))
        return table.drop_columns(["place", "payload"]).append_column("payload", pa.array(payloads, pa.binary()))

    return run


def reassemble(key, table):
    """For a block: the ids of its documents, from the answers to its words."""
    counts, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    by_bucket = np.argsort(table.column("bucket").to_numpy(), kind="stable").tolist()  # the block's own row comes first
    for k in by_bucket[1:]:
        n, ids = unpack(table.column("payload")[k].as_py())
        counts.append(numbers(n).astype(np.int64))
        flat.append(numbers(ids))
    size, flat = np.concatenate(counts), np.concatenate(flat).astype(np.int32)
    bucket, lengths, at, known, numbered = unpack(table.column("payload")[by_bucket[0]].as_py())
    # the answers stand by bucket; the block's words by how often it has them
    order = np.argsort(numbers(bucket), kind="stable")
    starts, sizes = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    starts[order], sizes[order] = np.cumsum(size) - size, size
    at, past = numbers(at), np.cumsum(numbers(lengths).astype(np.int64))
    lists = [flat[arrays.ragged(starts[own], sizes[own])] for own in np.split(at, past[:-1])]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    arrays.trim()
    ids = pa.array(np.frombuffer(numbered, "<i8"), mask=~np.frombuffer(known, np.uint8).astype(bool))
    return pa.table({"doc_id": ids, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))})


def encode(docs: DataFrame, path: str, pattern: str, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) for each row, by the ranks in ``path``, each match of ``pattern`` on its own.

    ``docs`` is read from a table: a repeated task must find the same rows to cut the same blocks."""
    batch_bytes(docs.sparkSession, block_bytes)
    n_buckets = buckets(docs, bucket_bytes)
    rows = docs.select("doc_id", "text").mapInArrow(cut(pattern, n_buckets, block_bytes), ROWS_DDL).repartition(n_buckets, "place")
    back = rows.groupBy("place").applyInArrow(answer(path, pattern), BACK_DDL)
    return back.groupBy("block").applyInArrow(reassemble, "doc_id long, ids array<int>")


def decoded(path: str):
    """For mapInArrow: counts and digests of the ids and of the bytes that they stand for."""

    def run(batches):
        table = {i: t for t, i in ranks(path).items()}
        parts, names = [table.get(i, b"") for i in range(max(table) + 1)], [str(i) for i in range(max(table) + 1)]
        for b in batches:
            ids, n, a, d = b.column("ids"), [], [], []
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = flat[s:e].tolist()
                n.append(len(own))
                a.append(hashlib.sha256(",".join(map(names.__getitem__, own)).encode()).hexdigest())
                d.append(hashlib.sha256(b"".join(map(parts.__getitem__, own))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            arrays.trim()

    return run


def decode_texts(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``bytes``: what the ids stand for."""

    def run(batches):
        table = {i: t for t, i in ranks(path).items()}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([b"".join(table[i] for i in x) for x in b.column("ids").to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return encode(docs, path, pattern).mapInArrow(decoded(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
