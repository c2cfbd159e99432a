"""Exact duplicates by progressive refinement, in DataFrame operations only.

Texts are equal when identical after lower-casing A-Z. Rows are grouped by length;
only those whose length repeats give a hash of a short prefix and are grouped by both;
and only where length and prefix meet another row is the whole text normalised and
hashed. Of each level one row per key and task is shuffled.

Defined results: a null text counts as empty, and all empty texts are copies of one
another; of equal texts the row with the largest ``doc_id`` stays (null lowest); rows
that repeat a ``doc_id`` and its text share the verdict and are all counted in
``group_size``; an empty table gives no rows. Columns other than ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free, materialize, read, text_or_empty

PREFIX_CHARS = 64
#: Keys of this many rows and fewer (about 40 bytes each) are broadcast; more are shuffled.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row per text that occurs twice or more: ``n_bytes``, ``text_sha256``, ``keep_id``, ``group_size``."""
    text = text_or_empty()
    size = F.octet_length(text).alias("n_bytes")
    lengths = materialize(docs.select(size).groupBy("n_bytes").agg(F.count("*").alias("n")).filter("n > 1").select("n_bytes"), "lengths")
    heads = docs.select(size, F.substring(text, 1, PREFIX_CHARS).alias("head")).join(_small(lengths, lengths.count()), "n_bytes", "left_semi")
    pairs = heads.select("n_bytes", F.xxhash64(ascii_lower(F.col("head"))).alias("prefix")).groupBy("n_bytes", "prefix").agg(F.count("*").alias("n"))
    left = materialize(pairs.filter("n > 1").select("n_bytes", "prefix"), "prefixes")
    survivors = docs.select(F.col("doc_id"), text.alias("text"), size, F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS))).alias("prefix"))
    survivors = survivors.join(_small(left, left.count()), ["n_bytes", "prefix"], "left_semi")
    whole = survivors.select("doc_id", "n_bytes", F.sha2(ascii_lower(F.col("text")), 256).alias("text_sha256"))
    return whole.groupBy("n_bytes", "text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    text = text_or_empty()
    groups = materialize(duplicate_groups(docs), "copies")
    all_docs = docs.select("doc_id", F.octet_length(text).alias("n_bytes"), F.sha2(ascii_lower(text), 256).alias("text_sha256"))
    joined = all_docs.join(_small(groups, groups.count()), ["n_bytes", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each group of equal texts, all columns kept. Repeats of the row that stays go, too: of rows that share
    ``doc_id`` and text but differ elsewhere, any one stays."""
    columns = docs.columns
    n_bytes, sha, keep, copy = (free(c, columns) for c in ("_n_bytes", "_sha", "_keep", "_copy"))
    text = text_or_empty()
    groups = materialize(duplicate_groups(docs), "copies")
    n = groups.count()
    key = [F.octet_length(text).alias(n_bytes), F.sha2(ascii_lower(text), 256).alias(sha)]
    known = groups.select(F.col("n_bytes").alias(n_bytes), F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep), F.lit(True).alias(copy))
    marked = docs.select("*", *key).join(_small(known, n), [n_bytes, sha], "left")
    single = marked.filter(F.col(copy).isNull()).select(*columns)
    # what stays of each group is one row, even if its doc_id is repeated
    staying = marked.filter(F.col(copy) & F.col("doc_id").eqNullSafe(F.col(keep)))
    return single.unionByName(staying.dropDuplicates([sha]).select(*columns))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
WINDOW w AS (PARTITION BY text_sha256)
"""
