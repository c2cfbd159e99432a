import hashlib

import public_tokenizers as P
import pyarrow.parquet as pq

from gleanery.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", "it's 12 o'clock,  two  spaces\n\n x", "日本語 テキスト 🙂 <|endoftext|>", "a" * 50_000, "the " * 20_000, "\t \n "]


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_ids_and_round_trip(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], 1), (None, TEXTS[2], 1)], "doc_id long, text string, block int")
    enc = bpe.encoder(PATH, P.PATTERN)
    coded = bpe.encode(docs, PATH, P.PATTERN)
    got = coded.collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert r.ids == enc(TEXTS[2 if r.doc_id is None else r.doc_id] or "")
    for r in bpe.decode_texts(coded, PATH).collect():
        assert bytes(r.bytes).decode() == (TEXTS[2 if r.doc_id is None else r.doc_id] or "")
    assert bpe.digests(docs.limit(0), PATH, P.PATTERN).collect() == []


def test_many_blocks_and_buckets(spark):
    rows = [(i, " ".join(f"w{(i * k) % 37} x{k % 11}" for k in range(i % 31))) for i in range(150)]
    enc = bpe.encoder(PATH, P.PATTERN)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = bpe.encode(docs, PATH, P.PATTERN, block_bytes=400, bucket_bytes=150).collect()
    assert {r.doc_id: r.ids for r in got} == {i: enc(t) for i, t in rows} and len(got) == len(rows)


def test_whole_table(spark, sf):
    table = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    texts, enc = dict(zip(table["doc_id"], table["text"], strict=True)), bpe.encoder(PATH, P.PATTERN)
    got = bpe.op8_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = enc(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((texts[r.doc_id] or "").encode()))
