"""Connected components by alternating large and small stars; nothing is collected but two sums a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(e: DataFrame) -> DataFrame:
    both = _both(e)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``links`` has the long columns ``a`` and ``b``; gives ``node`` and ``label``, the least node reached from it, for every linked node but the labels.

    ``known`` is what an earlier call gave, materialised: its stars stand for the links of that call, so that only what
    is new has to be followed."""
    if known is not None:
        if links.isEmpty():
            return known
        links = links.select("a", "b").unionByName(known.select(F.col("node").alias("a"), F.col("label").alias("b")))
    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    before = None
    while True:
        edges = materialize(_small(_large(edges)), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = now
