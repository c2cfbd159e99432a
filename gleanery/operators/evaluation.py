"""Retrieval quality: recall at k, top-1 accuracy, reciprocal rank, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KS = (1, 5, 10, 20)


def per_query(run: DataFrame, relevant: DataFrame) -> DataFrame:
    """``run``: query, rank (from 1), candidate. ``relevant``: query, candidate. One row per query of ``relevant``."""
    n = relevant.groupBy("query").agg(F.count_distinct("candidate").alias("n_relevant"))
    hits = run.join(relevant.distinct(), ["query", "candidate"], "left_semi")
    found = hits.groupBy("query").agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in KS])
    both = n.join(found, "query", "left")
    recalls = [(F.coalesce(f"hits_{k}", F.lit(0)) / F.greatest("n_relevant", F.lit(1))).alias(f"recall_{k}") for k in KS]
    return both.select("query", *recalls, F.coalesce(F.try_divide(F.lit(1.0), "first"), F.lit(0.0)).alias("reciprocal_rank"), (F.coalesce("first", F.lit(0)) == 1).alias("top_1"), F.col("first").isNotNull().alias("covered"))


def summary(each: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return each.agg(
        F.count("*").alias("n_queries"),
        *[F.coalesce(F.avg(f"recall_{k}"), zero).alias(f"recall_{k}") for k in KS],
        F.coalesce(F.avg("reciprocal_rank"), zero).alias("mrr"),
        F.coalesce(F.avg(F.col("top_1").cast("double")), zero).alias("top_1_accuracy"),
        F.coalesce(F.avg(F.col("covered").cast("double")), zero).alias("coverage"),
    )


def report(summary_row: DataFrame) -> DataFrame:
    """The summary as lines of text."""
    from ..functions import text

    lines = [F.format_string("queries: %d", "n_queries"), *[F.concat(F.lit(f"recall@{k}: "), text.percent(F.col(f"recall_{k}"))) for k in KS]]
    lines += [F.concat(F.lit(f"{n}: "), text.percent(F.col(c))) for n, c in (("top-1", "top_1_accuracy"), ("coverage", "coverage"))]
    return summary_row.select(F.explode(F.array(*lines, F.format_string("mrr: %.3f", "mrr"))).alias("line"))


def legacy_mrr(each: DataFrame) -> DataFrame:
    """The other definition: a query counts 1 as soon as anything relevant was found."""
    return each.agg(F.coalesce(F.avg(F.col("covered").cast("double")), F.lit(0.0)).alias("mrr"))


def reduction(raw, kept):
    """Per cent that suppression removed, 0 where there was nothing."""
    return F.when(raw > 0, (1 - kept / raw) * 100).otherwise(0.0)


def counts_agree(ours, theirs, most: float):
    """Whether two counts differ by at most a share of the second; with a second of 0 only 0 agrees."""
    return F.when(theirs == 0, ours == 0).otherwise(F.abs(ours - theirs) / theirs <= most)
