import random
import re

import pyarrow as pa
import pyarrow.parquet as pq

from gleanery.llm import near_dedup as nd


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[^\x20\x09-\x0d]+", t or "")]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {(a, b) for own in by.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    for a, b in pairs:
        x = len(sets[a] & sets[b])
        if 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
            up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def flat(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_chains_groups_and_edges(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows, base = [], [word() for _ in range(200)]
    for i in range(60):  # a group of variants, and chains whose ends are far apart
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = word()
        rows.append((1000 - i, " ".join(t)))
    chain = [word() for _ in range(150)]
    for i in range(20):
        chain[i * 7] = word()
        rows.append((i, " ".join(chain)))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "Two words"), (2004, "two WORDS"), (2005, "one"), (2006, "ÉÉ two words"), (2007, "x " * 50_000), (2008, "x " * 50_001)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class int")
    assert flat(nd.near_duplicates(docs, 3, 85)) == brute(rows, 3, 85)
    assert flat(nd.near_duplicates(docs, 5, 80)) == brute(rows, 5, 80)
    assert nd.near_duplicates(docs.limit(0)).collect() == []


def test_null_ids_and_repeats(spark):
    t = "a b c d e f g"
    docs = spark.createDataFrame([(5, t), (5, t), (None, t), (7, t.upper()), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(docs, 3, 85).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (None, None, True), (None, None, True)], key=str)
    assert nd.drop_near_copies(docs, 3, 85).count() == 4


def test_rows_of_one_id_are_judged_each_by_its_own_text(spark):
    word = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, word("a")), (2, word("a") + " more"), (2, word("b")), (2, word("c"))]  # one row of id 2 is a near copy
    rows += [(3, word("d")), (3, word("d") + " more"), (4, word("d") + " less")]  # near copies that share an id
    rows += [(None, word("b")), (2, None), (2, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _digest string")
    kept = nd.drop_near_copies(docs, 3, 85)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept.columns == docs.columns
    of_three = [r for r in got if r[0] == 3]
    assert len(of_three) == 1 and of_three[0] in rows
    assert [r for r in got if r[0] != 3] == sorted([rows[k] for k in (0, 2, 3, 7, 8, 9)], key=str)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert flat(nd.op4_near_dedup(spark, sf)) == brute(list(zip(t["doc_id"], t["text"], strict=True)), 3, 85)


def test_pigeonhole_index_holds_every_pair_within_the_distance():
    import numpy as np

    rng, chunks = np.random.default_rng(1), 3
    for _ in range(200):
        a = rng.integers(0, 1 << 16, chunks * nd.WIDTH).astype("<u2")
        b = a.copy()
        b[rng.choice(len(a), chunks * (nd.ERRORS + 1) - 1, replace=False)] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([9, 9]), pa.array([a.tobytes(), b.tobytes()])], ["class", "n", "signature"])
        out = next(nd._index(chunks)([batch])).to_pydict()
        mine = {k for k, c in zip(out["key"], out["class"], strict=True) if c == 1}
        assert mine & {k for k, c in zip(out["key"], out["class"], strict=True) if c == 2}


def test_central_classes_are_tried_before_whole_groups(spark, monkeypatch):
    """400 texts of one group, of which many are just too far from all others: these are still compared with many (11,098 pairs without that round)."""
    rng, tried, rows = random.Random(3), {}, []
    for k in range(400):
        words = [f"w{i}" for i in range(150)]
        for e in range(rng.randint(1, 7)):
            words[rng.randrange(150)] = f"x{k}_{e}"
        rows.append((k, " ".join(words)))
    plain = nd.materialize

    def seen(df, name):
        out = plain(df, name)
        if name in ("central-tried", "cross-tried"):
            tried[name] = out.count()
        return out

    monkeypatch.setattr(nd, "materialize", seen)
    got = flat(nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85))
    assert got == brute(rows, 3, 85) and sum(kept for *_, kept in got) > 20
    assert 0 < tried["central-tried"] < len(rows) and sum(tried.values()) < 10_500, tried
