import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from gleanery.llm import exchange, lm


def split(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x20\x09-\x0d]+", t or "")] + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Plain:
    """The model with explicit backoff: dictionaries of counts, one probability at a time."""

    def __init__(self, rows, order):
        self.order, self.counts = order, Counter()
        for i, t in rows:
            if not held(i):
                w = [0, *split(t)]
                for k in range(1, order + 1):
                    self.counts.update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
        # 0 stands for the start, which no text can hold
        self.n = sum(c for g, c in self.counts.items() if len(g) == 1 and g != (0,))
        self.v = sum(len(g) == 1 and g != (0,) for g in self.counts)

    def p(self, context, word):
        if not context:
            return (self.counts[(word,)] + 1) / (self.n + self.v + 1)
        if not self.counts[context]:
            return self.p(context[1:], word)
        left = lm.MU / (self.counts[context] + lm.MU)
        if not self.counts[(*context, word)]:
            return left * self.p(context[1:], word)
        return self.counts[(*context, word)] / (self.counts[context] + lm.MU) + left * self.p(context[1:], word)

    def score(self, text):
        w = [0, *split(text)]
        return sum(math.log10(self.p(tuple(w[max(0, j - self.order + 1) : j]), w[j])) for j in range(1, len(w)))


def brute(rows, order=lm.ORDER):
    """rows: (doc_id, text)."""
    m, out = Plain(rows, order), []
    for i, t in rows:
        w = split(t)
        base = sum(math.log10(m.p((), x)) for x in w)
        out.append((i, held(i), len(w), sum(m.counts[(x,)] > 0 for x in w), m.n, round(base, 6), round(m.score(t), 6)))
    return sorted(out, key=str)


def flat(got):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got), key=str)


ROWS = [(1, "The the cat\tSAT on"), (2, None), (3, ""), (4, "a " * 30_000), (5, "Éa éa ÉA"), (None, "the cat"), (1, "The the cat\tSAT on"), (17, "new words here the cat sat on new the cat"), (18, "the cat sat"), (19, "<s> the")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", b"x") for r in rows], "doc_id long, text string, block string, payload binary")


def test_edges(spark):
    for order in (2, 3, 4):
        assert flat(lm.score_texts(frame(spark, ROWS), order).collect()) == brute(ROWS, order)
    assert lm.score_texts(frame(spark, ROWS).limit(0)).collect() == []


def test_many_blocks_and_buckets(spark):
    """Documents of one task in several blocks, and more buckets than blocks."""
    rows = [(i, " ".join(f"w{(i * k * 7 + k) % 23}" for k in range(i % 29))) for i in range(120)]
    assert flat(lm.score_texts(frame(spark, rows).coalesce(2), block_bytes=300, bucket_bytes=100).collect()) == brute(rows)


def test_a_text_across_chunks(spark):
    rows = [(1, " ".join(f"w{i % 1013}" for i in range(400_000))), (2, "w1 w2 w3"), (3, None)]
    assert flat(lm.score_texts(frame(spark, rows)).collect()) == brute(rows)


def test_probabilities_of_each_state_sum_to_one_and_steps_are_the_traversal():
    rows = [(None, "a b a b c"), (None, "a b c"), (None, "b c a c"), (17, "zz a b qq")]  # 17 is held out
    assert held(17) and not any(held(i) for i, _ in rows[:-1])
    m = Plain(rows, 3)
    ((payload,),) = [b.column("payload").to_pylist() for b in [_cut(rows)]]
    block = lm.Block(payload, 3)
    counts = [n for _, n, _, _ in block.grams]  # one block: its own counts are the totals
    a = lm.Automaton(block, counts, m.n, m.v)
    known = np.flatnonzero(counts[0] > 0).tolist()
    unknown = np.flatnonzero(counts[0] == 0).tolist()
    states = {0, a.start, *a.next, *a.root_next}
    assert len(states) > 8
    for s in states:
        assert abs(sum(10 ** a.step(s, w)[0] for w in [*known, unknown[0]]) - 1) < 1e-12
    for k, (_, t) in enumerate(rows):
        words = block.number[block.first[k] : block.first[k + 1]].tolist()
        state, total = a.start, 0.0
        for w in words:
            add, state = a.step(state, w)
            total += add
        assert abs(total - a.score(words)) < 1e-12 and abs(total - m.score(t)) < 1e-9


def _cut(rows):
    from unittest import mock

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    with mock.patch.object(lm, "TaskContext") as task:
        task.get.return_value.partitionId.return_value = 0
        return next(iter(lm.cut(1 << 20)([batch])))


def test_hashes_and_buckets_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        h = np.unique(np.append(rng.integers(0, 2**64, n, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)))
        assert (exchange.unpack_ascending(exchange.pack_ascending(h)) == h).all()
        for buckets in (1, 7, 300):
            e = exchange.edges(h, buckets)
            assert e[0] == 0 and e[-1] == len(h) and (np.diff(e) >= 0).all()
            for b in range(buckets):
                assert all(int(x) * buckets >> 64 == b for x in h[e[b] : e[b + 1]])


def test_whole_table(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert flat(lm.op9_lm_scores(spark, sf).collect()) == brute(list(zip(t["doc_id"], t["text"], strict=True)))
