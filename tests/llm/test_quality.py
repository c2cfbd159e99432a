import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from gleanery.llm import quality


def test_held_out_accuracy_and_fold(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op10_quality(spark, sf).collect()}
    assert len(got) == pq.read_metadata(f"{sf}/documents.parquet").num_rows
    labels = pq.read_table(f"{sf}/labels.parquet").to_pydict()
    held = [(got[i], q) for i, q in zip(labels["doc_id"], labels["quality"], strict=True) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in got.values()) < len(got) / 3
    assert np.mean([r.predicted == q for r, q in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 7), (1, "", 7), (2, "x", 7), (2, "x", 7), (None, "y " * 90_000, 7)], "doc_id long, text string, _score_ int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    w = quality.fit(docs, labels)
    got = quality.score(docs, w).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score and got[2].score == got[3].score
    none = quality.fit(docs, labels.limit(0))
    assert all(r.score == 0.5 for r in quality.score(docs, none).collect())
    assert quality.score(docs.limit(0), none).collect() == []


def test_scores_are_dot_products():
    texts = pa.array(["Ab cd ab, 12 ###", "", None, "x"])
    w = np.random.default_rng(0).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    for t, s in zip(texts, quality.score_batch(texts, w), strict=True):
        data, at = quality.arrays.column_bytes(pa.array([t.as_py()]))
        i, x = quality.as_row(quality.features(data, at)[0])
        assert abs(1 / (1 + np.exp(-float(w[i] @ x))) - s) < 1e-6


def test_shapes_match_a_plain_version():
    text = "Ab cd's ÄÖ 12,345 ###x A a"
    data, at = quality.arrays.column_bytes(pa.array([text]))
    index, first = quality.features(data, at)
    n = len(text.split())
    assert list(first) == [0, n + (n - 1) + n + (n - 1) + (n - 2)]


def plain_ftrl(rows, labels, epochs):
    """FTRL-proximal, one weight at a time."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= quality.L1:
            return 0.0
        return -(zi - (quality.L1 if zi > 0 else -quality.L1)) / ((quality.BETA + n.get(i, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i, _ in row}
            p = 1 / (1 + np.exp(-sum(w[i] * x for i, x in row)))
            for i, x in row:
                g = (p - y) * x
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_training_matches_plain_ftrl():
    texts = ["good words in a row", "### junk @@ 12 12", "more good words here", "junk ### ###", "", "words and junk"]
    labels = np.array([1.0, 0.0, 1.0, 0.0, 1.0, 0.0])
    rows = []
    for t in texts:
        data, at = quality.arrays.column_bytes(pa.array([t]))
        rows.append(quality.as_row(quality.features(data, at)[0]))
    got = quality.train(rows, labels, 3)
    want = plain_ftrl([list(zip(i.tolist(), x.tolist(), strict=True)) for i, x in rows], labels.tolist(), 3)
    assert set(np.flatnonzero(got).tolist()) == {i for i, w in want.items() if w}
    assert all(abs(got[i] - w) < 1e-5 for i, w in want.items())


def test_features_tell_ngrams_apart_and_shares_add_up():
    def bag(t):
        data, at = quality.arrays.column_bytes(pa.array([t]))
        return sorted(quality.features(data, at)[0].tolist())

    assert bag("ab cd") == bag(" ab\tcd ") != bag("cd ab")
    # the same shapes: only the words as written, two single and one pair, differ
    a, b = bag("abc 123"), bag("xyz 456")
    assert len(a) == len(b) == 6 and len(set(a) & set(b)) == 3
    # a pair never crosses documents
    data, at = quality.arrays.column_bytes(pa.array(["ab", "cd"]))
    index, first = quality.features(data, at)
    assert sorted(index[: first[1]].tolist()) == bag("ab") and sorted(index[first[1] :].tolist()) == bag("cd")


def test_one_text_of_each_labelled_id_is_learnt(spark):
    docs = spark.createDataFrame([(1, "a good text")] * 3 + [(1, "zz"), (2, "### junk")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    once = spark.createDataFrame([(1, "zz"), (2, "### junk")], "doc_id long, text string")
    assert (quality.fit(docs, labels) == quality.fit(once, labels)).all()
