"""Exact nearest-neighbour search over vector columns.

The vectors are scanned once, wherever they are; the queries travel to them. A set of
queries of a checked size is sent to every task and multiplied with whole Arrow
batches; each batch gives its best k rows per query, so that what is shuffled does not
grow with the vectors' number of columns, and the best k are ranked per query. A larger
set never comes to the driver: blocks of queries meet blocks of vectors, each one matrix
product, and Spark keeps a task's best k per query before it shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries sent to every task at once: at most this many floats (32 MB as doubles).
QUERY_FLOATS = 4_000_000
#: Of a larger set, floats of a block of queries and of a block of vectors (2 MB each as doubles).
PACKED_FLOATS = 250_000


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _search(ids: np.ndarray, queries: np.ndarray, k: int | None, least: float | None):
    def run(batches):
        unit = _unit(queries)
        for b in batches:
            scores = _unit(_matrix(b.column("vector"))) @ unit.T if b.num_rows else np.zeros((0, len(ids)))
            own = b.column("id").to_numpy()
            keep_q, keep_v = [], []
            for q in range(len(ids)):
                s = scores[:, q]
                if k is not None and len(s) > k:
                    cut = np.partition(s, len(s) - k)[len(s) - k]  # ties at the cut all stay; the ranking breaks them by id
                    hit = np.flatnonzero(s >= cut)
                else:
                    hit = np.arange(len(s))
                if least is not None:
                    hit = hit[s[hit] >= least]
                keep_q.append(np.full(len(hit), q))
                keep_v.append(hit)
            q, v = np.concatenate(keep_q), np.concatenate(keep_v)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[v]), pa.array(scores[v, q])], ["query_id", "id", "score"])

    return run


def _packed(floats: int):
    """For mapInArrow: some vectors a row, as their ids and one matrix, of about ``floats`` values."""

    def run(batches):
        for b in batches:
            n = len(b.column("vector")[0]) if b.num_rows else 1
            step = max(1, floats // max(n, 1))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                ids = part.column("id").to_numpy().astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ids]), pa.array([_matrix(part.column("vector")).astype("<f8").tobytes()])], ["ids", "matrix"])

    return run


def _search_packed(k: int | None, least: float | None):
    """For mapInArrow: rows of some vectors beside some queries."""

    def unpack(ids, matrix):
        n = np.frombuffer(ids.as_py(), "<i8")
        return n, np.frombuffer(matrix.as_py(), "<f8").reshape(len(n), -1)

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                own, m = unpack(b.column("ids")[row], b.column("matrix")[row])
                ids, queries = unpack(b.column("query_ids")[row], b.column("query_matrix")[row])
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1)))
                yield from _search(ids, queries, k, least)([pa.RecordBatch.from_arrays([pa.array(own), vectors], ["id", "vector"])])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """``query_id``, ``id``, ``score`` (cosine; 0 for a zero vector), ``rank`` (from 1; ties by id).

    Both frames have ``id`` (long) and ``vector`` (array of float, one length for all). With ``k``
    the best k per query, with ``least`` those of at least that similarity. A query's own row counts."""
    schema = "query_id long, id long, score double"
    own, asked = (df.select(F.col("id").cast("long").alias("id"), "vector").filter("vector is not null") for df in (vectors, queries))
    n, dim = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    floats = n * (dim or 0)
    if floats <= QUERY_FLOATS:
        table = asked.toArrow()
        ids = table.column("id").to_numpy().astype(np.int64)
        found = own.mapInArrow(_search(ids, _matrix(table.column("vector").combine_chunks()), k, least), schema) if n else vectors.sparkSession.createDataFrame([], schema)
    else:
        blocks = asked.mapInArrow(_packed(PACKED_FLOATS), "ids binary, matrix binary").toDF("query_ids", "query_matrix")
        blocks = blocks.repartition(1 + floats // (64 * PACKED_FLOATS))
        found = own.mapInArrow(_packed(PACKED_FLOATS), "ids binary, matrix binary").crossJoin(blocks).mapInArrow(_search_packed(k, least), schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k) if k is not None else ranked


def best_per_group(found: DataFrame, group: str, *more: str) -> DataFrame:
    """The best row per query and group; ties by id."""
    best = F.max_by(F.struct("id", "score", *more), F.struct("score", -F.col("id")))
    return found.groupBy("query_id", group).agg(best.alias("best")).select("query_id", group, "best.*")
