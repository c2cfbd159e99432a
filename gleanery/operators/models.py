"""The boundary to models: anything that turns rows of images into rows of boxes or vectors.

A model is a factory, called once per Python worker, of a function from an Arrow batch to
one. Queries run from precomputed vectors alone; the stub below stands in for a model in
tests and gives the same vector for the same content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Model = Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]
_loaded: dict[str, Callable] = {}


def apply(df: DataFrame, name: str, model: Model, schema: str) -> DataFrame:
    """Runs ``model`` over the rows; its session is made once per worker and kept under ``name``."""

    def run(batches):
        if name not in _loaded:
            _loaded[name] = model()
        for b in batches:
            yield _loaded[name](b)

    return df.mapInArrow(run, schema)


def stub_embedder(dim: int = 64, column: str = "content", key: str = "id") -> Model:
    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for x in b.column(column).to_pylist():
                raw = x.encode() if isinstance(x, str) else bytes(x or b"")
                v = np.random.default_rng(int.from_bytes(hashlib.sha256(raw).digest()[:8], "little")).normal(size=dim)
                out.append((v / np.linalg.norm(v)).astype(np.float32))
            return pa.RecordBatch.from_arrays([b.column(key).cast(pa.int64()), pa.array(out, pa.list_(pa.float32()))], ["id", "vector"])

        return run

    return make
