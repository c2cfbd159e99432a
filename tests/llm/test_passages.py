import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from gleanery.llm import arrays, exchange, passages, repeats


def brute(texts):
    """Per text: whether 51 words in a row stand in another text too."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    own = [{tuple(w[i : i + 51]) for i in range(len(w) - 50)} for w in words]
    n = Counter(x for s in own for x in s)
    return [any(n[x] > 1 for x in s) for s in own]


def made():
    rng = random.Random(13)
    words = lambda n: ["".join(rng.choices("abcdé", k=rng.randrange(1, 9))) for _ in range(n)]
    text = lambda *parts: " ".join(w for p in parts for w in p)
    short, long, line = words(51), words(300), words(30)
    texts = [None, "", "one", text(short), text(words(200), short, words(90)), text(short[:50], words(40)), "\n\t".join(words(7) + short), text(short).upper()]
    texts += [text(words(9), long, words(5)), text(words(60), long[100:151], words(3)), text(long[40:90], words(80)), text(long[240:291])]
    twice = words(60)
    texts += [text(twice, words(30), twice)]  # in one document only
    texts += [text(words(50), line, words(50)) for _ in range(30)]  # a line of 30 words that all have
    for k in range(60):  # passages on either side of the 51 words, at all offsets
        at = rng.randrange(0, 240)
        texts.append(text(words(rng.randrange(0, 80)), long[at : at + rng.randrange(45, 60)], words(rng.randrange(0, 80)), line))
    return [*texts, text(twice[:52], words(3)), texts[9], "a " * 300, "a " * 51, "a " * 50]


@pytest.mark.parametrize("block,bucket", [(16 << 20, 16 << 20), (3000, 700)])
def test_passages_at_all_offsets(spark, block, bucket):
    texts = made()
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, gram int").repartition(3)
    keys = {r.key for r in passages.sharing_keys(docs, block, bucket).collect()}
    got = {r.doc_id: r.key in keys for r in docs.select("doc_id", passages.document_key().alias("key")).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert 40 < sum(want) < len(want) - 30


def test_short_passages_lose_no_byte_but_are_told(spark):
    rng = random.Random(17)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    passage = words(55)  # 329 bytes
    docs = spark.createDataFrame([(1, f"{words(90)} {passage} {words(80)}"), (2, f"{passage} {words(99)}"), (3, words(300)), (None, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.shares_passage) for r in repeats.remove_repeats(docs).collect()}
    assert got == {1: (0, True), 2: (0, True), 3: (0, False), None: (0, False)}


def test_repeated_rows_shuffled_documents_and_empty(spark, monkeypatch):
    monkeypatch.setattr(passages, "BROADCAST_ROWS", 0)
    texts = made()
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    keys = {r.key for r in passages.sharing_keys(docs).collect()}
    key = [r.key for r in docs.select(passages.document_key().alias("key")).collect()]
    assert [k in keys for k in key] == brute(texts)
    same = spark.createDataFrame([(1, "b " * 60), (1, "b " * 60), (None, "c " * 60), (2, "d " * 60)], "doc_id long, text string")
    assert sorted((r.doc_id, r.shares_passage) for r in repeats.remove_repeats(same).collect() if r.doc_id) == [(1, True), (1, True), (2, False)]
    assert passages.sharing_keys(docs.limit(0)).collect() == []


def test_whole_table(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = dict(zip(t["doc_id"], brute(t["text"]), strict=True))
    got = repeats.op5_remove_repeats(spark, sf).collect()
    assert len(got) == len(want) and all(r.shares_passage == want[r.doc_id] for r in got)
    assert any(want.values())


def test_buckets_of_anchors_are_alike():
    rng = random.Random(19)
    data = np.frombuffer(" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60_000)).encode(), np.uint8)
    _, gram, _, _ = passages.Windows(data, np.array([0, len(data)])).frames()
    sizes = np.bincount(exchange.bucket(gram, 16), minlength=16)
    assert len(gram) > 2000 and sizes.max() < 1.5 * sizes.mean()
