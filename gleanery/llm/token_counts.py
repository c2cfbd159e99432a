"""Token counts through a digest cache.

A text's count depends on its content and the tokenizer alone. Both are digested
(content: SHA-256 of the text, a null being empty, otherwise unchanged, as any other
normalisation would alter counts; tokenizer: SHA-256 of its file). Stored counts are
joined by digest, the distinct texts without one are encoded, and their counts are
appended to the cache for all later runs.

Digests are looked up before any text moves. A few misses (BROADCAST_ROWS) are sent to
the scan, so that only their texts are shuffled, and none where all are stored; beyond
that, copies are folded map-side and the misses found in the same partitioning. Either
way a text that makes up a third of all rows reaches the encoder once. Defined results: null counts as empty; an empty text has 0
tokens; repeated rows get the same count each; an empty table gives no rows; columns
other than ``doc_id`` and ``text`` are not read. Lost executors repeat their tasks;
the append is committed as a whole, and a row stored twice is folded when read.

The query keeps its cache in the folder that the setting CACHE_SETTING names, below the
tokenizer's version, for all runs that share the setting; without it in one of its own
below ``spark.checkpoint.dir``, which goes with the driver.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import re
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, remove, text_or_empty, work_dir

OVER = 1024
CACHE_SETTING = "spark.gleanery.tokenCounts"
#: Misses up to this count (some 60 bytes each) are broadcast.
BROADCAST_ROWS = 200_000
CACHE = "digest binary, version string, n_tokens long"
#: Latin text without rare control characters, on which all Unicode tables agree; other texts go to the library itself.
PLAIN = re.compile("[^\x09-\x0d\x20-\x7e\xa0-ɏ]")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character: itself, or else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts tokens as the library does for the file at ``path``."""

    def __init__(self, path: str):
        self.path, self.fast, self.marks = path, None, []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.slow = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.slow = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            self._speed_up(json.load(f))

    def _speed_up(self, spec: dict) -> None:
        """Plain byte-level BPE whose ids follow its merges gives the same counts in tiktoken, several times faster."""
        pre, model, vocab = spec.get("pre_tokenizer") or {}, spec["model"], spec["model"].get("vocab", {})
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        if (
            model.get("type") != "BPE"
            or spec.get("normalizer")
            or pre.get("type") != "ByteLevel"
            or pre.get("add_prefix_space")
            or pre.get("use_regex") is False
            or model.get("dropout")
            or model.get("ignore_merges")
            or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges))
        ):
            return
        import tiktoken

        letters, marks = _letters(), [x["content"] for x in spec.get("added_tokens", [])]
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in set(marks)}
        if len(ranks) != 256 + len(merges):
            return
        self.fast, self.marks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), marks

    def counts(self, texts: list[str]) -> list[int]:
        out, rest = [0] * len(texts), []
        for i, t in enumerate(texts):
            if self.fast is not None and not PLAIN.search(t) and not any(m in t for m in self.marks):
                out[i] = len(self.fast.encode_ordinary(t))
            else:
                rest.append(i)
        for k in range(0, len(rest), 64):
            some = rest[k : k + 64]
            for i, n in zip(some, self.slow([texts[i] for i in some]), strict=True):
                out[i] = n
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def count_tokens(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` for each row; ``cache`` is a folder all executors reach."""
    spark = docs.sparkSession
    version = version_of(tokenizer)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    text = text_or_empty()
    digest = F.unhex(F.sha2(text, 256))
    texts = docs.select(digest.alias("digest"), text.alias("text"))
    fold = lambda df: df.groupBy("digest").agg(F.first("text").alias("text"))
    if stored.isEmpty():
        misses = fold(texts)
    else:
        unknown = materialize(docs.select(digest.alias("digest")).distinct().join(stored, "digest", "left_anti"), "misses")
        few = unknown.count() <= BROADCAST_ROWS
        misses = fold(texts.join(F.broadcast(unknown), "digest", "left_semi")) if few else fold(texts).join(unknown, "digest", "left_semi")

    def encode(batches):
        count = counter(tokenizer)
        for b in batches:
            n = count.counts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])

    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
    return rows.join(known, "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    kept = spark.conf.get(CACHE_SETTING, None)
    cache = f"{kept}/{version_of(path)}" if kept else f"{work_dir(spark)}/gleanery-token-counts-{uuid.uuid4().hex}"
    if not kept:
        atexit.register(remove, spark, cache)
    counted = count_tokens(read(spark, sf_dir, "documents"), path, cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > OVER).alias("over_limit"))
