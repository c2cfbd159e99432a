import hashlib

import pyarrow.parquet as pq

from gleanery.llm import exact_dedup as xd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_bytes string, prefix string, _sha int"


def brute(rows):
    """rows: (doc_id, text)."""
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for i, t in rows:
        key = (t or "").translate(LOWER)
        keep = max(groups[key], key=lambda x: (x is not None, x or 0))
        out.append((i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


def flat(got):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", "p", 1) for i, t in rows], SCHEMA)


LONG = "long words " * 100_000
ROWS = [
    (1, "Same Text"), (2, "same text"), (3, "same texT "), (4, None), (5, ""), (6, "É"), (7, "é"), (None, "SAME TEXT"), (None, "alone"), (8, "x" * 64 + "a"), (9, "x" * 64 + "b"),
    (9, "x" * 64 + "b"), (10, LONG), (11, LONG.upper()), (12, LONG + "!"), (13, "ab"), (14, "ba"), (13, "same text"), (-5, "Same text"), (15, " "), (16, "\t"),
]


def test_edges_match_brute_force(spark):
    assert flat(xd.exact_dedup(frame(spark, ROWS)).collect()) == brute(ROWS)
    assert xd.exact_dedup(frame(spark, ROWS).limit(0)).collect() == []


def test_keys_beyond_the_broadcast_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(xd, "BROADCAST_ROWS", 0)
    assert flat(xd.exact_dedup(frame(spark, ROWS)).collect()) == brute(ROWS)


def test_a_third_of_all_rows_in_one_group(spark):
    rows = [(i, "hot Text" if i % 3 == 0 else f"text {i % 700}") for i in range(3000)]
    assert flat(xd.exact_dedup(frame(spark, rows)).collect()) == brute(rows)


def test_drop_copies(spark):
    got = xd.drop_copies(frame(spark, ROWS))
    assert got.columns == frame(spark, []).columns
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    want = {}
    for (i, t), b in zip(ROWS, (next(x for x in brute([r for r in ROWS]) if x[0] == r[0] and x[4] == hashlib.sha256((r[1] or "").translate(LOWER).encode()).hexdigest()) for r in ROWS), strict=True):
        if b[3]:
            want[b[4]] = (i, (t or "").translate(LOWER))
    assert sorted(((i, (t or "").translate(LOWER)) for i, t in kept), key=str) == sorted(want.values(), key=str)
    assert xd.drop_copies(got.limit(0)).collect() == []


def test_rows_that_differ_elsewhere(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "A", "y"), (2, "b", "z")], "doc_id long, text string, source string")
    got = xd.drop_copies(df).collect()
    assert sorted(r.doc_id for r in got) == [1, 2]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert flat(xd.op3_exact_dedup(spark, sf).collect()) == brute(list(zip(t["doc_id"], t["text"], strict=True)))
