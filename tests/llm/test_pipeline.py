import hashlib

import public_tokenizers as P
import pyarrow.parquet as pq
from pyspark.sql.functions import col, when
from test_near_dedup import brute as near

import corpus_pipeline
from gleanery.llm import bpe, quality


def test_run_matches_stage_by_stage_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"] or "") for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = quality.score_batch(pq.read_table(f"{sf}/documents.parquet")["text"].combine_chunks(), weights)
    rows = [r for r, s in zip(rows, score, strict=True) if s >= quality.THRESHOLD]
    low = lambda t: t.encode().lower()
    last = {}
    for i, t in rows:
        last[low(t)] = max(i, last.get(low(t), i))
    rows = [(i, t) for i, t in rows if last[low(t)] == i]
    kept = {d for d, _, _, own in near(rows, 5, 80) if own}
    rows = [r for r in rows if r[0] in kept]
    items = pq.read_table(f"{sf}/benchmark.parquet")["text"].to_pylist()
    words = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
    joined = lambda t: " " + " ".join(words(t)) + " "
    rows = [(i, t) for i, t in rows if not any(joined(x) in joined(t) for x in items)]
    enc = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = {i: (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for i, t in rows for ids in [enc(t)]}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def test_columns_and_rows_through_the_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for c in ("_score", "_sha", "_digest", "_keep", "class", "digest", "text_sha256"):
        docs = docs.withColumn(c, when(col("doc_id") >= 0, "x"))
    labels_dir = "/root/testdata/sf0.001"
    now = docs.limit(30).union(docs.limit(5)).union(spark.createDataFrame([(None,) * 12, (None, "x", "en", "s", 1, *"abcdefg")], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, labels_dir)
        assert now.columns == docs.columns and now.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, now, labels_dir).count() == now.count()
