import re

import pyarrow.parquet as pq

from gleanery.llm import decontaminate as dc

ITEM = "If Alice buys 12 apples at 3 dollars each and Bob buys 7 pears how much do they pay in total today"
OTHER = "If Carol buys 40 apples at 9 dollars each and David buys 5 pears how much do they pay in total today"
MIXED = "If Carol buys 40 apples at 9 dollars each and Carol buys 5 pears how much do they pay in total today"
SCHEMA = "doc_id long, text string, digest string, at string"


def run(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "d", "a") for i, t in texts], SCHEMA)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, hash int")
    return sorted(((r.doc_id, r.contaminated, r.n_items, r.item_id, r.exact) for r in dc.decontaminate(docs, bench).collect()), key=str)


def test_copies_templates_and_slots(spark):
    texts = [(1, f"intro words here {ITEM} and more"), (2, f"Well: {OTHER}."), (3, MIXED), (4, ITEM.upper()), (5, None), (6, ""), (7, "If Alice buys 12 apples at 3 dollars"), (8, "w " * 60_000 + ITEM)]
    got = {r[0]: r for r in run(spark, texts, [(9, ITEM), (10, ITEM), (11, None), (None, ITEM), (12, "")])}
    assert got[1] == (1, True, 1, 9, True)
    assert got[2] == (2, True, 1, 9, False)
    assert not got[3][1]  # one name stands for two: not the same question
    assert got[4][1] and got[8][1]
    assert not any(got[k][1] for k in (5, 6, 7))


def test_short_items_repeats_and_empty(spark):
    short = "eight small words make a very short item"
    got = run(spark, [(1, "x " + short + " y"), (1, "clean"), (None, short), (2, "seven small words make a very short")], [(3, short), (4, "seven small words make a very short")])
    assert [(r[0], r[1]) for r in got] == [(1, False), (1, True), (2, False), (None, True)]
    assert all(not r[1] for r in run(spark, [(1, short)], []))
    assert run(spark, [], [(1, short)]) == []


def test_whole_table_against_plain_windows(spark):
    sf = "/root/testdata/sf0.01"
    tok = lambda t: re.findall("[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + dc.WINDOW]) for i in range(len(w) - dc.WINDOW + 1)}
    items = set().union(*[grams(tok(t)) for t in pq.read_table(f"{sf}/benchmark.parquet")["text"].to_pylist()])
    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = {i for i, t in zip(docs["doc_id"], docs["text"], strict=True) if grams(tok(t)) & items}
    got = dc.op6_decontaminate(spark, sf).collect()
    assert len(got) == len(docs["doc_id"]) and {r.doc_id for r in got if r.contaminated} == want


def test_verbatim_windows_count_whatever_changed_elsewhere(spark):
    item = "Alice has 3 red apples and 5 green pears in one big basket near the old barn while Bob counts 5 brown eggs for Alice"
    texts = [
        (1, item.replace("has 3", "has 5")),  # 3 -> 5 where a 5 stays 5; "red ... eggs" stands word for word
        (2, item.replace("for Alice", "for Carol")),  # one of two occurrences of a name
        (3, MIXED),  # no 13 words in a row as they were
        (4, item),
    ]
    got = {r[0]: r for r in run(spark, texts, [(8, item), (9, ITEM)])}
    assert got[1] == (1, True, 1, 8, False) and got[2] == (2, True, 1, 8, False)
    assert not got[3][1]
    assert got[4] == (4, True, 1, 8, True)
