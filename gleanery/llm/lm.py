"""Language-model scores by a weighted backoff automaton.

A state is a context of up to ORDER - 1 tokens that was seen in training (the empty one
and the text's start included). It has an arc for each token that followed it, weighted
with the smoothed log-probability, and a failure arc to the state of its longest proper
suffix, weighted with the mass left for tokens that did not follow; the empty state has
an arc for every token. A text is traversed once from left to right, carrying the state
and adding up weights: while the state has no arc for the token its failure arc is
taken, then the arc, which leads to the state of the longest context now seen.

    p(w)      = (c(w) + 1) / (N + V + 1)
    p(w | h)  = (c(h w) + MU p(w | h')) / (c(h) + MU)     arc, if c(h w) > 0
              = MU / (c(h) + MU) * p(w | h')              failure arc to h', then its arc

h' is h without its first token; the probabilities of each state sum to 1, the unknown
token's share included. No n-gram is pruned.

The corpus is cut into blocks of whole documents, each a row of a table in the shared
folder. A block sends its distinct n-grams and their training counts to buckets by hash
and gets the totals back, so a word or pair in a third of all documents is one entry per
block; it then builds the part of the automaton that its own texts can reach. Neither
the model nor the vocabulary is ever held whole anywhere. The number of buckets follows
the table's bytes, so that a bucket has some BUCKET_BYTES of text to answer for.

Words, on which the base score rests, are told apart by 96 bits (two hashes), longer
n-grams by 56: of 10**11 distinct ones about one in a million shares its count with
another, and each byte more would add a tenth of the input to what is sent. Defined results: a
null text is empty and has the end token alone; a null ``doc_id`` counts as training;
repeated rows each count and get the same score; an empty table gives no rows; other
columns are not read. Blocks are written before they are used, so that a task repeated
after a lost executor finds the same ones.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, exchange
from .bpe import numbers, pack, unpack
from .common import batches_of, buckets, let_go, materialize, partitions, read

ORDER, MU = 3, 50.0
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 6 << 20
FOLDS, HELD_OUT = 7, 2
END, START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
#: Of longer n-grams 56 bits are sent.
GRAM_BITS = ~np.uint64(0xFF)
OWN = -1
ROWS = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("payload", pa.binary())])
ROWS_DDL = "block string, bucket int, payload binary"


def held(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(ROWS.types)], schema=ROWS)


def cut(block_bytes: int):
    """For mapInArrow: blocks of whole documents, one row each."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, at = arrays.column_bytes(batch.column("text"))
            for a, b, some, own in arrays.chunks(data, at, block_bytes):
                ids = batch.column("doc_id").slice(a, b - a)
                known = np.array(ids.is_valid().to_pylist(), np.uint8)
                text = zstandard.ZstdCompressor(level=5).compress(some.tobytes())
                yield _rows([(f"{part}-{seq}", OWN, pack(np.diff(own), known.tobytes(), np.array(ids.fill_null(0).to_pylist(), "<i8").tobytes(), text))])
                seq += 1
                arrays.trim()

    return run


class Block:
    """A block's documents, and its distinct n-grams of each length in the order of their hashes."""

    def __init__(self, payload: bytes, order: int):
        lengths, known, ids, text = unpack(payload)
        at = np.concatenate(([0], np.cumsum(numbers(lengths).astype(np.int64))))
        self.ids = pa.array(np.frombuffer(ids, "<i8"), mask=~np.frombuffer(known, np.uint8).astype(bool))
        self.held = [held(i) for i in self.ids.to_pylist()]
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)
        hashes, starts, ends, sizes = [], [], [], []
        for a, _, some, own in arrays.chunks(data, at):
            h, first = arrays.word_hashes(some, own)
            s, e, _ = arrays.word_bounds(some, own)
            for out, x, last in ((hashes, h, END), (starts, s + at[a], 0), (ends, e + at[a], 0)):
                out.append(np.insert(x, first[1:], last))
            sizes.append(np.diff(first) + 1)
        tokens = np.concatenate(hashes)
        self.first = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        trains = np.repeat(~np.array(self.held, bool), np.diff(self.first))
        place = np.arange(len(tokens)) - np.repeat(self.first[:-1], np.diff(self.first))
        words, at_word, self.number = np.unique(tokens, return_index=True, return_inverse=True)
        raw = arrays.LOWER[data].tobytes()
        bounds = (np.concatenate(x)[at_word].tolist() for x in (starts, ends))
        self.check = np.fromiter((zlib.crc32(raw[s:e]) for s, e in zip(*bounds, strict=True)), np.uint32, len(words))  # a second hash of each word
        del raw, hashes, starts, ends
        #: per length: hashes, training counts here, a place of each, and each place's n-gram (-1: none that long ends there)
        self.grams = [(words, np.bincount(self.number[trains], minlength=len(words)), at_word, self.number)]
        before = arrays.mix(tokens)
        for k in range(2, order + 1):
            context = np.concatenate((before[:1], before[:-1]))
            if k == 2:
                context[place == 0] = arrays.mix(np.array([START]))[0]
            before = arrays.mix(context * np.uint64(3) + tokens)
            whole = np.flatnonzero(place >= k - 2)
            h, index, back = np.unique(before[whole] & GRAM_BITS, return_index=True, return_inverse=True)
            of = np.full(len(tokens), -1, np.int64)
            of[whole] = back
            self.grams.append((h, np.bincount(back[trains[whole]], minlength=len(h)), whole[index], of))
        self.begins = place == 0


def ask(n_buckets: int, order: int):
    """For mapInArrow on blocks: their distinct n-grams and training counts, by bucket."""

    def run(batches):
        for batch in batches:
            for name, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                block = Block(payload.as_py(), order)
                edge = [exchange.edges(h, n_buckets) for h, *_ in block.grams]
                rows = []
                for b in np.flatnonzero(sum(np.diff(e) for e in edge)).tolist():
                    own = [slice(e[b], e[b + 1]) for e in edge]
                    parts = [block.check[own[0]]]
                    for (h, n, *_), some in zip(block.grams, own, strict=True):
                        parts += [exchange.pack_ascending(h[some]), n[some]]
                    rows.append((name, b, pack(*parts)))
                yield _rows(rows)
                del block
                arrays.trim()

    return run


def total(key, table):
    """For applyInArrow on a bucket: its n-grams are totalled, and each block answered in its own order.

    One more row, without a block, has the bucket's number of distinct training words and of training tokens."""
    asked = [unpack(p.as_py()) for p in table.column("payload")]
    answers, stat = [[] for _ in asked], b""
    for k in range(len(asked[0]) // 2):
        own, counts = [exchange.unpack_ascending(x[1 + 2 * k]) for x in asked], [numbers(x[2 + 2 * k]).astype(np.int64) for x in asked]
        every = np.concatenate(own)
        if k:
            _, at = np.unique(every, return_inverse=True)
        else:
            at = exchange.named(every, np.concatenate([numbers(x[0]) for x in asked]))
        sums = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        if not k:
            stat = int((sums > 0).sum()).to_bytes(8, "little") + int(sums.sum()).to_bytes(8, "little")
        for x, part in zip(answers, np.split(sums[at], np.cumsum([len(x) for x in own])[:-1]), strict=True):
            x.append(part)
    bucket = table.column("bucket")[0].as_py()
    rows = [(name, bucket, pack(*x)) for name, x in zip(table.column("block").to_pylist(), answers, strict=True)]
    return pa.Table.from_batches([_rows([*rows, (None, bucket, stat)])])


def _array(kind: str, x: np.ndarray) -> array:
    out = array(kind)
    out.frombytes(np.ascontiguousarray(x.astype({"i": np.int32, "d": np.float64}[kind])).tobytes())
    return out


class Automaton:
    """The states and arcs for a block's n-grams, given their counts in the whole training part."""

    def __init__(self, block: Block, counts: list[np.ndarray], n_tokens: int, n_words: int):
        order, n = len(block.grams), len(block.grams[0][0])
        end = np.flatnonzero(block.grams[0][0] == END)
        texts = int(counts[0][end[0]]) if len(end) else 0
        self.start, size = n + 1, n + 2
        p = (counts[0] + 1) / (n_tokens + n_words + 1)
        # a context not seen in training is no state: its longest suffix that was stands for it; after the end the text is over
        goes_on = block.grams[0][0] != END
        state = [np.where((counts[0] > 0) & goes_on, np.arange(n) + 1, 0)]
        self.root_weight, self.root_next = _array("d", np.log10(p)), _array("i", state[0])
        self.base = np.log10(p)
        fail = [np.zeros(n + 2, np.int64)]
        left = [np.concatenate(([0.0], np.log10(MU / (counts[0] + MU)), [np.log10(MU / (texts + MU))]))]
        source, word, weight, target = [], [], [], []
        for k in range(2, order + 1):
            _, _, place, _ = block.grams[k - 1]
            c, shorter = counts[k - 1], block.grams[k - 2]
            suffix, context = shorter[3][place], shorter[3][place - 1]  # the (k - 1)-grams that end here and one token before
            begins = block.begins[place]  # only for k = 2, as longer ones have a token before
            context_count = np.where(begins, texts, counts[k - 2][context])
            context_state = np.where(begins, self.start, state[k - 2][context])
            p = (c + MU * p[suffix]) / (context_count + MU)
            seen = np.flatnonzero(c > 0)
            if k < order:
                state.append(np.where((c > 0) & goes_on[block.number[place]], size + np.arange(len(c)), state[k - 2][suffix]))
                size += len(c)
                fail.append(state[k - 2][suffix])
                left.append(np.log10(MU / (c + MU)))
                leads = state[k - 1]
            else:
                leads = state[k - 2][suffix]
            source.append(context_state[seen])
            word.append(block.number[place[seen]])
            weight.append(np.log10(p[seen]))
            target.append(leads[seen])
        source, word, weight, target = (np.concatenate(x) for x in (source, word, weight, target))
        by = np.argsort(source << 32 | word)
        self.begin = _array("i", np.searchsorted(source[by], np.arange(size + 1)))
        self.word, self.weight, self.next = _array("i", word[by]), _array("d", weight[by]), _array("i", target[by])
        self.fail, self.fail_weight = _array("i", np.concatenate(fail)), _array("d", np.concatenate(left))

    def step(self, state: int, word: int) -> tuple[float, int]:
        """Weight and next state: failure arcs until there is an arc for the word, then that."""
        total = 0.0
        while state:
            low, high = self.begin[state], self.begin[state + 1]
            k = bisect_left(self.word, word, low, high)
            if k < high and self.word[k] == word:
                return total + self.weight[k], self.next[k]
            total += self.fail_weight[state]
            state = self.fail[state]
        return total + self.root_weight[word], self.root_next[word]

    def score(self, words: list[int]) -> float:
        """One traversal from the start state; ``step`` written out, as it runs for every token."""
        begin, arc, weight, leads, fail, left = self.begin, self.word, self.weight, self.next, self.fail, self.fail_weight
        total, state = 0.0, self.start
        for w in words:
            while state:
                high = begin[state + 1]
                k = bisect_left(arc, w, begin[state], high)
                if k < high and arc[k] == w:
                    total += weight[k]
                    state = leads[k]
                    break
                total += left[state]
                state = fail[state]
            else:
                total += self.root_weight[w]
                state = self.root_next[w]
        return total


def traverse(order: int, n_tokens: int, n_words: int):
    """For applyInArrow on a block and its answers: its documents' scores."""

    def run(key, table):
        by_bucket = np.argsort(table.column("bucket").to_numpy(), kind="stable").tolist()
        block = Block(table.column("payload")[by_bucket[0]].as_py(), order)  # the block's own row comes first
        parts = [unpack(table.column("payload")[k].as_py()) for k in by_bucket[1:]]
        counts = [np.concatenate([numbers(x[k]) for x in parts]).astype(np.int64) for k in range(order)]
        automaton = Automaton(block, counts, n_tokens, n_words)
        scores = [automaton.score(block.number[s:e].tolist()) for s, e in zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True)]

        def per_doc(x):
            return np.add.reduceat(x, block.first[:-1])

        out = pa.table(
            {
                "doc_id": block.ids,
                "held_out": pa.array(block.held, pa.bool_()),
                "n_tokens": pa.array(np.diff(block.first), pa.int64()),
                "n_known": pa.array(per_doc((counts[0][block.number] > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(scores), n_tokens), pa.int64()),
                "base_score": pa.array(per_doc(automaton.base[block.number]), pa.float64()),
                "score": pa.array(scores, pa.float64()),
            }
        )
        del block, automaton
        arrays.trim()
        return out

    return run


def score_texts(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Learns from the training fold of ``docs`` and scores every row."""
    spark = docs.sparkSession
    n_buckets = buckets(docs, bucket_bytes)
    with batches_of(spark, block_bytes):
        blocks = materialize(docs.select("doc_id", "text").mapInArrow(cut(block_bytes), ROWS_DDL), "blocks")
    with batches_of(spark, 1):  # a block at a time
        asked = blocks.mapInArrow(ask(n_buckets, order), ROWS_DDL).repartition(n_buckets, "bucket")
        back = materialize(asked.groupBy("bucket").applyInArrow(total, ROWS_DDL), "ngrams")
    del asked
    let_go(spark)
    stats = back.filter("block is null").select("payload").mapInArrow(_stats, "words long, tokens long").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).collect()[0]
    run = traverse(order, stats.tokens or 0, stats.words or 0)
    both = blocks.unionByName(back.filter("block is not null")).repartition(max(partitions(spark), blocks.count()), "block")
    return both.groupBy("block").applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _stats(batches):
    for b in batches:
        x = [p.as_py() for p in b.column("payload")]
        yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(p[k : k + 8], "little") for p in x], pa.int64()) for k in (0, 8)], ["words", "tokens"])


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))
