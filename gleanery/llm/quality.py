"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates, scored as sparse dot products.

Features are word 1- and 2-grams as written, and 1- to 3-grams of the words' shapes
(letters as ``a`` or ``A``, digits as ``0``, runs folded, marks kept), so that a junk
word never seen before still looks like junk. Each is hashed to one of 2**BITS weights;
a document's value for a feature is its share of the document's n-grams.

Labels are read from ``labels`` only for rows outside the held-out fold, and of these
the first ``train_rows`` in the order of a hash of ``doc_id`` (a documented bound; every
row is scored). Neither labels nor lang, source or doc_id enter a score. Defined
results: null and empty texts score what the bias alone gives; repeated documents get
the same score each; null labels are ignored, and of several labels of a document the
largest counts, of several texts of a labelled ``doc_id`` the greatest; with no labels at all every score is 0.5; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import arrays
from .common import batch_bytes, materialize, read

BITS, TRAIN_ROWS, EPOCHS, FOLDS = 20, 12_000, 4, 5
THRESHOLD = 0.3
BATCH_BYTES = 4 << 20
SCALE = 16.0
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a chunk of documents: the weight each n-gram falls to, and where each document's n-grams start (one more)."""
    starts, ends, first = arrays.word_bounds(data, at)
    sums = arrays.running(data)
    words = arrays.mix(arrays.stretch(sums, starts, ends) + (ends - starts).astype(np.uint64))
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | arrays.SPACE[data[1:]]
    keep[starts] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    folded = arrays.running(shape[keep])
    s, e = place[starts], place[ends]
    shapes = arrays.mix(arrays.stretch(folded, s, e) ^ np.uint64(0x5A5A5A5A5A5A5A5A))
    n, doc = len(starts), np.repeat(np.arange(len(at) - 1), np.diff(first))
    index, owner = [], []
    for view, (h, orders) in enumerate(((words, (1, 2)), (shapes, (1, 2, 3)))):
        for k in orders:
            if n < k:
                continue
            g = arrays.mix(arrays.ngrams(h, k) + np.uint64(view * 8 + k)) >> np.uint64(64 - BITS)
            whole = doc[: n - k + 1] == doc[k - 1 :]
            index.append(g[whole].astype(np.int64))
            owner.append(doc[: n - k + 1][whole])
    index = np.concatenate(index) if index else np.zeros(0, np.int64)
    owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return index[order], np.searchsorted(owner[order], np.arange(len(at)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal on (weight indices, values) rows in the order given; the last weight is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for (i, x), y in zip(rows, labels, strict=True):
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(size)).astype(np.float32)


def as_row(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct weights with their shares, and the bias."""
    i, c = np.unique(index, return_counts=True)
    return np.append(i, 1 << BITS), np.append(SCALE * c / max(1, len(index)), 1.0)


def score_batch(text: pa.Array, w: np.ndarray) -> np.ndarray:
    data, at = arrays.column_bytes(text)
    out = np.zeros(len(at) - 1)
    for a, b, some, own in arrays.chunks(data, at):
        index, first = features(some, own)
        sums = np.concatenate(([0.0], np.cumsum(w[index], dtype=np.float64)))
        size = np.diff(first)
        out[a:b] = SCALE * (sums[first[1:]] - sums[first[:-1]]) / np.maximum(size, 1)
    return 1 / (1 + np.exp(-np.clip(out + float(w[-1]), -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """The weights (2**BITS + 1 floats: 4 MB, whatever the input). Trained in one task over at most ``train_rows`` rows."""
    batch_bytes(docs.sparkSession, BATCH_BYTES)
    seen = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    seen = seen.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    chosen = materialize(seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "labelled")
    # bounded by train_rows: of rows that share a chosen doc_id the greatest text is learnt
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.max("text").alias("text"))

    def rows(batches):
        for b in batches:
            data, at = arrays.column_bytes(b.column("text"))
            packed = []
            for _, _, some, own in arrays.chunks(data, at):
                index, first = features(some, own)
                for s, e in zip(first[:-1], first[1:], strict=True):
                    i, x = as_row(index[s:e])
                    packed.append(i.astype(np.int32).tobytes() + x.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y").cast(pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "y", "packed"])
            arrays.trim()

    def learn(table):
        table = table.combine_chunks()
        ids = table.column("doc_id").to_numpy()
        order = np.lexsort((ids, arrays.mix(ids.astype(np.uint64))))
        y = table.column("y").to_numpy()[order].astype(float)
        own = []
        for k in order:
            raw = table.column("packed")[int(k)].as_py()
            half = len(raw) // 2
            own.append((np.frombuffer(raw[:half], np.int32), np.frombuffer(raw[half:], np.float32).astype(float)))
        return pa.table({"weights": pa.array([train(own, y, epochs).tobytes()], pa.binary())})

    found = texts.mapInArrow(rows, "doc_id long, y int, packed binary").groupBy(F.lit("all").alias("all")).applyInArrow(learn, "weights binary").collect()
    return np.frombuffer(bytes(found[0].weights), np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """``docs`` with ``column``, a name of its own, added last."""
    batch_bytes(docs.sparkSession, BATCH_BYTES)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_batch(b.column("text"), sent.value), pa.float64())], [*b.schema.names, column])
            arrays.trim()

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(column, DoubleType())]))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
