import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from gleanery.llm import token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "plain words, it's 12 o'clock", "a <|endoftext|> b", "日本語 テキスト 🙂", "x\u0085y \x1c z", "éàü ²³ ½", "  two  \n\n spaces \t", "word " * 30_000]


def library(texts):
    t = Tokenizer.from_file(JSON)
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_counts_cache_and_repeats(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "z"), (None, TEXTS[2], "z")], "doc_id long, text string, digest string")
    cache = str(tmp_path / "cache")
    got = token_counts.count_tokens(docs, JSON, cache).collect()
    want = dict(enumerate(library(TEXTS))) | {None: library(TEXTS)[2]}
    assert len(got) == len(TEXTS) + 2 and all(r.n_tokens == want[r.doc_id] for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == len(TEXTS) - 1  # null and empty are one text
    again = token_counts.count_tokens(docs.union(spark.createDataFrame([(99, "new", "z")], docs.schema)), JSON, cache).collect()
    assert len(again) == len(got) + 1 and spark.read.parquet(cache).count() == len(TEXTS)
    assert token_counts.count_tokens(docs.limit(0), JSON, cache).collect() == []


def test_other_tokenizers(spark, tmp_path):
    docs = spark.createDataFrame([(0, "hello world"), (1, None)], "doc_id long, text string")
    for name in ("piece_bpe_32k.model", "word_bpe_49k.json"):
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, public_tokenizers.path(name), str(tmp_path / name)).collect()}
        assert got[0] == token_counts.counter(public_tokenizers.path(name)).slow(["hello world"])[0] > 0 and got[1] == 0


def test_whole_table(spark, sf):
    table = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = dict(zip(table["doc_id"], library(table["text"]), strict=True))
    got = token_counts.op2_token_counts(spark, sf).collect()
    assert len(got) == len(want) and all(r.n_tokens == want[r.doc_id] for r in got)


def test_a_second_run_uses_what_is_stored(spark, sf, tmp_path):
    spark.conf.set(token_counts.CACHE_SETTING, str(tmp_path))
    try:
        first = sorted(token_counts.op2_token_counts(spark, sf).collect())
        folder = f"{tmp_path}/{token_counts.version_of(JSON)}"
        stored = spark.read.parquet(folder).count()
        # a count that no encoder gives shows that the second run reads it
        old = spark.read.parquet(folder).orderBy("digest").limit(1).selectExpr("digest", "version", "n_tokens + 1000000 AS n_tokens")
        old.write.mode("append").parquet(folder)
        again = sorted(token_counts.op2_token_counts(spark, sf).collect())
        assert spark.read.parquet(folder).count() == stored + 1
        assert [r.doc_id for r in first] == [r.doc_id for r in again] and sum(a != b for a, b in zip(first, again, strict=True)) > 0
        plan = spark.createDataFrame([(1, "x")], "doc_id long, text string")
        assert token_counts.count_tokens(plan, JSON, folder).collect()[0].n_tokens == 1
        assert spark.read.parquet(folder).count() == stored + 2
    finally:
        spark.conf.unset(token_counts.CACHE_SETTING)


def test_many_misses_beside_stored_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "BROADCAST_ROWS", 0)
    cache = str(tmp_path / "cache")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    token_counts.count_tokens(docs.limit(3), JSON, cache).collect()
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, JSON, cache).collect()} == dict(enumerate(library(TEXTS)))
    assert spark.read.parquet(cache).count() == len(TEXTS) - 1
