"""Vector tables, and the import of vectors stored as little-endian 32-bit floats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id long, vector array<float>"


def decode(df: DataFrame, column: str = "blob", tolerant: bool = False) -> DataFrame:
    """Adds ``vector``. A blob whose length is no multiple of 4 gives NULL, or with ``tolerant`` loses its last bytes."""
    names = [c for c in df.columns if c != "vector"]

    def run(batches):
        for b in batches:
            out = []
            for x in b.column(column):
                raw = x.as_py()
                if raw is not None and len(raw) % 4:
                    raw = raw[: len(raw) // 4 * 4] if tolerant else None
                out.append(None if raw is None else np.frombuffer(raw, "<f4"))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(out, pa.list_(pa.float32()))], [*names, "vector"])

    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    own = df.select(*names)
    return own.mapInArrow(run, StructType([*own.schema, StructField("vector", ArrayType(FloatType()))]))


def encode(df: DataFrame) -> DataFrame:
    """``id``, ``blob``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([None if v is None else np.array(v, "<f4").tobytes() for v in b.column("vector").to_pylist()], pa.binary())], ["id", "blob"])

    return df.select("id", "vector").mapInArrow(run, "id long, blob binary")


MAGIC, NAME_BYTES = b"FVECTBIN", 64


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A binary store: magic, version and size (32 bits each), number (64 bits), the model's name, then the vectors by position.

    A file is read by one task, as its header says where its vectors are; an invalid one gives no rows."""

    def run(batches):
        head = len(MAGIC) + 4 + 4 + 8 + NAME_BYTES
        for b in batches:
            for raw in b.column("content").to_pylist():
                if raw is None or len(raw) < head or raw[: len(MAGIC)] != MAGIC:
                    continue
                dim, n = int.from_bytes(raw[12:16], "little"), int.from_bytes(raw[16:24], "little")
                if not dim:
                    continue
                n = min(n, (len(raw) - head) // (4 * dim))
                m = np.frombuffer(raw, "<f4", n * dim, head)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(m))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64)), vectors], ["id", "vector"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def read_or_empty(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """A missing table is an empty one."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def append(df: DataFrame, path: str, dim: int) -> None:
    """Vectors of another length fail the write."""
    checked = df.withColumn("vector", F.when(F.assert_true(F.size("vector") == dim, "wrong length").isNull(), F.col("vector")))
    checked.write.mode("append").parquet(path)


def rebuild(faces: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vectors of stored faces, by id; orphans go."""
    return vectors.join(faces.filter("storage_status = 'stored'").select("id"), "id", "left_semi").sortWithinPartitions("id")


def repeated(vectors: DataFrame, group: str, order: str, within: float = 0.01) -> DataFrame:
    """Vectors whose sum is within ``within`` of the one before, in each group."""
    from pyspark.sql.window import Window

    from ..functions import vector

    w = Window.partitionBy(group).orderBy(order)
    return vectors.withColumn("total", vector.total(F.col("vector"))).withColumn("before", F.lag("total").over(w)).filter(F.abs(F.col("total") - F.col("before")) < within)
