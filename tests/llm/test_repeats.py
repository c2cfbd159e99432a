import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from gleanery.llm import repeats, suffix_array


def brute(texts):
    """Per text: (n_bytes, n_removed, n_spans, kept_sha256)."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(b[i : i + 400]) for b in raw for i in range(len(b) - 399))
    out = []
    for b in raw:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 399):
            if seen[hash(b[i : i + 400])] > 1:
                cover[i] += 1
                cover[i + 400] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def row(r):
    return (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)


@pytest.mark.parametrize("hot,block,bucket", [(2000, 4 << 20, 8 << 20), (2, 4 << 20, 8 << 20), (2000, 3000, 700), (2, 3000, 700)])
def test_passages_edges_and_repeats(spark, hot, block, bucket):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdé fgh\n", k=n))
    shared, other = text(900), text(1500)
    texts = [None, "", "short", "x" * 1500, "ab" * 700, "abc" * 133 + "q", text(3000) * 2, shared, other[:380], other[:410], "pre " + other + " post"]
    for k in range(30):
        s = rng.randrange(0, 300)
        texts.append(text(rng.randrange(0, 600)) + shared[s : s + rng.randrange(380, 600)] + text(rng.randrange(0, 600)) + (other[k : k + 700] if k % 3 == 0 else ""))
    texts += [texts[12], text(399), text(400)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    got = {r.doc_id: row(r) for r in repeats.remove_repeats(docs, hot, block, bucket).collect()}
    want = brute(texts)
    for i in range(len(texts)):
        assert got[i] == want[i], i


def test_repeated_rows_null_ids_and_empty(spark):
    t = "".join(random.Random(5).choices("abcdefgh", k=900))
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "z")], "doc_id long, text string")
    got = repeats.remove_repeats(docs).collect()
    assert sorted(r.n_removed for r in got) == [0, 900, 900, 900]
    assert repeats.remove_repeats(docs.limit(0)).collect() == []


def test_texts_longer_than_a_chunk(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices("abcdefgh \n", k=n))
    passage = text(5000)
    texts = [text(1 << 20) + passage + text(700_000) + passage[:450], text(300) + passage[100:900], text((1 << 20) - 200) + passage, "x" * 1_100_000]
    got = {r.doc_id: row(r) for r in repeats.remove_repeats(spark.createDataFrame([(i, t, 1, "d") for i, t in enumerate(texts)], "doc_id long, text string, digest int, place string")).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_whole_table(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = dict(zip(t["doc_id"], brute(t["text"]), strict=True))
    got = repeats.op5_remove_repeats(spark, sf).collect()
    assert len(got) == len(want) and all(row(r) == want[r.doc_id] for r in got)
    assert sum(r.n_removed for r in got) > 0


def test_induced_sorting_and_prefixes_match_plain_sorting():
    rng = random.Random(7)
    for _ in range(300):
        n, k = rng.randrange(0, 60), rng.choice([1, 2, 3, 20])
        s = [rng.randrange(1, k + 1) for _ in range(n)] + [0]
        order = suffix_array.suffix_array(s, k + 1)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        again, m = suffix_array.repeated(s, k + 1, 4), Counter(tuple(s[i : i + 4]) for i in range(len(s) - 3))
        for i in range(len(s)):
            assert again[i] == (i + 4 <= len(s) and m[tuple(s[i : i + 4])] > 1)
