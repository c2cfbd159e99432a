"""A corpus from raw documents: quality filter, exact and near duplicates, benchmark decontamination, token ids.

Each stage works on all that its predecessor kept, and all but the last return the
columns of ``documents``. Rows repeat or lack values as they may: every stage's
operator states what it does with them. A document that the classifier rejects (score
under ``quality.THRESHOLD``) goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from gleanery.llm.common import free, materialize, read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = quality.fit(docs, read(spark, sf_dir, "labels"))
    column = free("_score", docs.columns)
    return quality.score(docs, weights, column).filter(F.col(column) >= quality.THRESHOLD).select(*docs.columns)


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_one_of_equal),
    ("minhash near-dedup", keep_one_of_near),
    ("benchmark decontamination", keep_clean_of_benchmark),
    ("byte-level bpe", to_tokens),
]

#: SQL cannot express the classifier or the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
