"""Online assignment of faces to persons, and its single step.

The online form is sequential by definition: every face is compared with those before it.
It runs per partition of the caller's choice (a library, an album) in order of ``id``; one
group's vectors are in one task, so groups are bounded by the caller.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def vote(neighbours: DataFrame, least: float) -> DataFrame:
    """``query_id``, ``person_id``, ``votes``, ``total``: most votes, then largest total, then smallest person; only where the best neighbour reaches ``least``."""
    votes = neighbours.groupBy("query_id", "person_id").agg(F.count("*").alias("votes"), F.sum("score").alias("total"), F.max("score").alias("top"))
    w = Window.partitionBy("query_id")
    ranked = votes.withColumn("best", F.max("top").over(w)).withColumn("n", F.row_number().over(w.orderBy(F.desc("votes"), F.desc("total"), "person_id")))
    return ranked.filter((F.col("n") == 1) & (F.col("best") >= least)).select("query_id", "person_id", "votes", "total")


def online(faces: DataFrame, group: str, least: float = 0.65, k: int = 10) -> DataFrame:
    """``group``, ``id``, ``person_id``: the id of the first face of the person."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        m = np.array(pdf["vector"].tolist(), float).reshape(len(pdf), -1)
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
        ids, person = pdf["id"].to_numpy(), np.zeros(len(pdf), np.int64)
        for i in range(len(pdf)):
            person[i] = ids[i]
            if i:
                s = m[:i] @ m[i]
                near = np.lexsort((np.arange(i), -s))[: min(k, i)]
                if s[near[0]] >= least:
                    votes: dict[int, list] = {}
                    for j in near:
                        v = votes.setdefault(int(person[j]), [0, 0.0])
                        v[0] += 1
                        v[1] += s[j]
                    person[i] = min(votes.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))[0]
        return pd.DataFrame({group: pdf[group], "id": ids, "person_id": person})

    kind = faces.schema[group].dataType.simpleString()
    return faces.select(group, "id", "vector").groupBy(group).applyInPandas(run, f"{group} {kind}, id long, person_id long")


def lsh(vectors: DataFrame, bucket_length: float = 2.0, tables: int = 3, seed: int = 7):
    """Approximate neighbours by random projections, for corpora where exact search is too dear."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    own = vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed).fit(own), own
