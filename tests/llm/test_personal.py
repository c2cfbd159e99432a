import time

import brute
import pyarrow.parquet as pq

from gleanery.llm import personal

TEXTS = [
    None,
    "",
    "a@b.c_d@e.f x@y a@b.c. mail a.b+c@d-e.f.g@h.i",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.255.0 1.2.3 12.34.56.789",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111110 1234 5678",
    "+1 (555) 123-4567 +49.30.1234567 +1- +12345 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
    "ñ é 🙂 mail: josé.x@y.org call +33 1 23 45 67 89",
    "1 " * 3_000 + "2" * 2_000,
    "a" * 2_000 + "@" + "b" * 1_000,
    "+1" + " " * 60_000,
    "x@" + "a." * 30_000 + "b",
]


def run(spark, df):
    at = f"{spark.conf.get('spark.checkpoint.dir')}/p"
    df.write.mode("overwrite").parquet(f"{at}/documents.parquet")
    return personal.op7_personal_data(spark, at).collect()


def test_base_spans_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "b") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "b"), (2, TEXTS[2], "b")], "doc_id long, text string, base string")
    got = run(spark, docs)
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = brute.personal(TEXTS[2 if r.doc_id is None else r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want, r.doc_id
    assert run(spark, docs.limit(0)) == []


def test_very_long_runs_neither_recurse_nor_rescan(spark):
    texts = ["1 " * 60_000 + "2" * 100_000, "a" * 300_000 + "@" + "b" * 200_000, "+1" + " " * 300_000, "7." * 100_000]
    began = time.time()
    got = run(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [(r.n_email, r.n_card, r.n_phone) for r in sorted(got)] == [(0, 0, 0)] * 4
    assert {r.doc_id: r.n_ip for r in got}[3] == 25_000
    assert time.time() - began < 120


def test_trees_add_what_looks_like_checked_spans(spark):
    rows = [(i, f"call {k} +1 (555) {200 + i}-{1000 + i} now") for i, k in enumerate(["phone"] * 60)] + [(100 + i, f"item {i}{i}{i}{i}{i}{i}{i}{i} and {i}.50") for i in range(1, 9)]
    rows.append((999, "call phone (555) 321-9876 now"))
    got = {r.doc_id: r for r in run(spark, spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[999].n_added == 1 and "digits:11:25" in got[999].spans
    assert all(got[100 + i].n_added == 0 for i in range(1, 9))


def test_expression_and_model_agree(spark):
    counts = [(f, float(f % 7), float(f % 5)) for f in range(64)]
    model = personal.fit_trees(counts)
    df = spark.createDataFrame([(c[0],) for c in counts], "flags int")
    for r in df.select("flags", personal._score(model, df["flags"]).alias("s")).collect():
        assert abs(r.s - personal.score(model, r.flags)) < 1e-9


def test_whole_table(spark, sf):
    texts = dict(zip(*pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values(), strict=True))
    got = personal.op7_personal_data(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.personal(texts[r.doc_id])


def test_thresholds_are_set_per_kind_on_scores_of_the_other_fold():
    sure, unsure = 1 << 4, 1 << 5  # flags that go with strict spans, and that do not
    counts = [(fold, kind, flags, float(p), float(n)) for fold in (0, 1) for kind, flags, p, n in ((5, sure, 100, 1), (5, unsure, 2, 300), (4, sure, 30, 20), (6, unsure, 0, 50))]
    models = [personal.fit_trees(personal._added_up(c[2:] for c in counts if c[0] != fold)) for fold in (0, 1)]
    least = personal.thresholds(models, counts)
    for kind, at in least.items():  # a plain count over every possible threshold
        judged = [(personal.score(models[f], x), p, n) for f, k, x, p, n in counts if k == kind]
        good = [s for s, _, _ in judged if (p := sum(b for a, b, _ in judged if a >= s)) >= personal.LEAST and p >= personal.PRECISION * (p + sum(c for a, _, c in judged if a >= s))]
        assert at == min(good, default=personal.math.inf)
    assert least[5] < personal.math.inf and least[4] == least[6] == personal.math.inf
    empty = personal.fit_trees([])
    assert set(personal.thresholds([empty, empty], []).values()) == {personal.math.inf}


def test_candidates_over_base_spans_add_nothing(spark):
    texts = ["mail a@b.org, c@d.org or e@f.org; call phone +1 (555) 200-1000 or (555) 200-1001 now"] * 60
    for r in run(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")):
        spans = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",")]
        assert r.n_email == 3 and all(a[1] <= b[0] or b[1] <= a[0] for a in spans for b in spans if a != b)
