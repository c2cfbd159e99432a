"""Near duplicates: a multi-index Hamming join of MinHash signatures, confirmed on full shingle sets.

A set's signature has ``chunks * WIDTH`` values of 16 bits. Two signatures that differ in
at most ``chunks * (ERRORS + 1) - 1`` values have, by the pigeonhole principle, a chunk
that differs in at most ERRORS; each chunk is therefore indexed once for every choice
of ERRORS values left out, and every pair within that distance meets in a bucket.
The number of chunks is what keeps the chance that a pair just at the threshold lies
beyond the distance under MISS.

Rows with one and the same shingle set are one class, and only classes are joined. In a
bucket, classes are first compared with one of its members only (that which shares most
buckets with others, so mostly what the others vary), which joins true groups. Where a bucket
still holds several components, its classes are compared across them, if the rarest
shingles of their sets meet (a condition that every link fulfils), so that no link
between components is lost and no group gives all pairs.

Defined results: null, empty and white-space texts have no shingles and link with
nothing; a text of fewer words than a shingle has is one shingle; rows with a null
``doc_id`` are counted but not linked (``component_id`` null, kept); rows that repeat a
``doc_id`` are one document if their sets are equal and may be linked each on its own
otherwise; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .common import batch_bytes, free, let_go, materialize, read, text_or_empty
from .components import components

WIDTH, ERRORS, MISS = 5, 1, 1e-5
BATCH_BYTES = 4 << 20
#: Document numbers up to this count (8 bytes each) are broadcast to pick their texts; more are shuffled.
BROADCAST_ROWS = 500_000
#: 2**COUNTER_BITS counters of 4 bytes are broadcast, whatever the input.
COUNTER_BITS = 21


def chunks_for(percent: int) -> int:
    s = percent / 100
    hit = sum(math.comb(WIDTH, e) * s ** (WIDTH - e) * (1 - s) ** e for e in range(ERRORS + 1))
    return max(1, math.ceil(math.log(MISS) / math.log(1 - hit)))


def shingle_sets(text: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as ascending hashes."""
    data, at = arrays.column_bytes(text)
    out = []
    for _, _, some, own in arrays.chunks(data, at):
        h, first = arrays.word_hashes(some, own)
        grams = arrays.ngrams(h, n)
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if e - s >= n:
                x = np.sort(grams[s : e - n + 1])
                out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
            else:
                out.append(arrays.ngrams(h[s:e], e - s) if e > s else np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sign(n: int, size: int):
    rng = np.random.Generator(np.random.PCG64(77))
    mul = rng.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, size, dtype=np.uint64)

    def signed(part: pa.RecordBatch) -> pa.RecordBatch:
        text = part.column("text")
        sets = shingle_sets(text, n)
        lengths = np.array([len(s) for s in sets], np.int64)
        some = np.flatnonzero(lengths)
        sig = np.zeros((len(some), size), "<u2")
        if len(some):
            flat, first = np.concatenate([sets[k] for k in some]), np.cumsum(lengths[some]) - lengths[some]
            for k in range(size):
                sig[:, k] = arrays.mix(np.minimum.reduceat(flat * mul[k] + add[k], first)) & np.uint64(0xFFFF)
        found = dict(zip(some.tolist(), sig, strict=True))
        return pa.RecordBatch.from_arrays(
            [
                *part.columns[:-1],
                pa.array(lengths, pa.int64()),
                pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([found[k].tobytes() if k in found else None for k in range(len(sets))], pa.binary()),
            ],
            [*part.schema.names[:-1], "n_shingles", "class", "signature"],
        )

    def run(batches):
        for b in batches:
            for part in arrays.slices(b, "text"):
                yield signed(part)

    return run


def _index(chunks: int):
    left = list(combinations(range(WIDTH), WIDTH - ERRORS))

    def run(batches):
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), "<u2").reshape(-1, chunks * WIDTH).astype(np.uint64)
            out = []
            for c in range(chunks):
                for j, own in enumerate(left):
                    h = np.full(len(sig), c * len(left) + j + 1, np.uint64)
                    for k in own:
                        h = arrays.mix(h * np.uint64(3) + sig[:, c * WIDTH + k] + np.uint64(1))
                    out.append(h.astype(np.int64))
            times = len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out)), *[pa.array(np.tile(b.column(c).to_numpy(), times)) for c in ("class", "n")]], ["key", "class", "n"]
            )

    return run


def _confirm(n: int, percent: int):
    def run(batches):
        last: tuple = (None, None)
        for b in (part for whole in batches for part in arrays.slices(whole, "x_text")):
            x, y = b.column("x"), b.column("y")
            own, keep = shingle_sets(b.column("x_text"), n), []
            for k, s in enumerate(own):
                if last[0] != (c := y[k].as_py()):
                    last = (c, shingle_sets(b.column("y_text").slice(k, 1), n)[0])
                t = last[1]
                both = np.concatenate((s, t))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.filter(keep), y.filter(keep)], ["a", "b"])

    return run


def _close(pairs: DataFrame, signatures: DataFrame, distance: int) -> DataFrame:
    """Pairs whose signatures differ in at most ``distance`` values."""
    both = pairs.join(signatures.select(F.col("class").alias("x"), F.col("signature").alias("sx")), "x").join(signatures.select(F.col("class").alias("y"), F.col("signature").alias("sy")), "y")

    def run(batches):
        for b in batches:
            sx, sy = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1)) for c in ("sx", "sy"))
            keep = pa.array((sx != sy).sum(axis=1) <= distance)
            yield pa.RecordBatch.from_arrays([b.column("x").filter(keep), b.column("y").filter(keep)], ["x", "y"])

    return both.mapInArrow(run, "x long, y long")


def _texts(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``class`` and ``text`` for each row (class, doc_id) of ``wanted``."""
    wanted = materialize(wanted, "wanted")
    ids = wanted.select("doc_id").distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_ROWS else ids

    def classed(batches):
        for b in (part for whole in batches for part in arrays.slices(whole, "text")):
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in shingle_sets(b.column("text"), n)], pa.int64()), b.column("text")], ["class", "text"])

    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(classed, "class long, text string")
    return materialize(texts.join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"]), "texts")


def _linked(texts: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (x, y) of classes that the full sets confirm, as (a, b)."""
    first = pairs.join(texts.select(F.col("class").alias("x"), F.col("text").alias("x_text")), "x")
    both = first.join(texts.select(F.col("class").alias("y"), F.col("text").alias("y_text")).hint("merge"), "y")
    return materialize(both.select("x", "y", "x_text", "y_text").mapInArrow(_confirm(n, percent), "a long, b long"), "confirmed")


def _prefixes(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``class``, ``shingle``, ``at``: of each set, the shingles of which a set linked with it must have one, and their places.

    Two sets with that similarity differ in few shingles, so in any order that all sets
    share, the first of each must meet; the order puts rare shingles first, so that
    members of a large group meet over what only some of them have. How rare a shingle
    is is read from counters of a fixed number, which its hash picks."""
    spark = texts.sparkSession

    def count(batches):
        for b in (part for whole in batches for part in arrays.slices(whole, "text")):
            sets = shingle_sets(b.column("text"), n)
            i, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(64 - COUNTER_BITS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(c.astype(np.int64))], ["i", "c"])

    counted = texts.select("text").mapInArrow(count, "i int, c long").groupBy("i").agg(F.least(F.sum("c"), F.lit(2**31 - 1)).cast("int").alias("c")).toArrow()
    counters = np.zeros(1 << COUNTER_BITS, np.int32)
    counters[counted.column("i").to_numpy()] = counted.column("c").to_numpy()
    sent = spark.sparkContext.broadcast(counters)

    def run(batches):
        for b in (part for whole in batches for part in arrays.slices(whole, "text")):
            out = []
            for s in shingle_sets(b.column("text"), n):
                rare = np.argsort(sent.value[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], kind="stable")  # ties by hash
                out.append(s[rare[: len(s) - -(-percent * len(s) // 100) + 1]].astype(np.int64))
            lengths = np.array([len(x) for x in out], np.int64)
            rows, at = pa.array(np.repeat(np.arange(len(out)), lengths)), arrays.ragged(np.zeros(len(out), np.int64), lengths)
            yield pa.RecordBatch.from_arrays([b.column("class").take(rows), pa.array(np.concatenate([np.zeros(0, np.int64), *out])), pa.array(at)], ["class", "shingle", "at"])

    return texts.mapInArrow(run, "class long, shingle long, at long")


def _signed(docs: DataFrame, n: int, percent: int, *more: Column) -> DataFrame:
    """``doc_id``, the long columns ``more``, ``n_shingles``, ``class`` and ``signature`` of each row."""
    batch_bytes(docs.sparkSession, BATCH_BYTES)
    rows = docs.select("doc_id", *more, "text")
    names = ", ".join(f"{c} long" for c in rows.columns[:-1])
    return materialize(rows.mapInArrow(_sign(n, chunks_for(percent) * WIDTH), f"{names}, n_shingles long, class long, signature binary"), "signatures")


def _labels(docs: DataFrame, signed: DataFrame, n: int, percent: int) -> DataFrame:
    """``class``, ``doc_id`` (its smallest) and ``label`` (of its component) for each class of rows with ids."""
    chunks = chunks_for(percent)
    distance = chunks * (ERRORS + 1) - 1
    classes = signed.filter("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = materialize(classes, "classes")
    reps = classes.select("class", "doc_id")
    index = classes.select("class", "n", "signature").mapInArrow(_index(chunks), "key long, class long, n long")
    shared = index.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = materialize(index.join(shared, "key"), "members")

    weight = members.groupBy("class").agg(F.sum(F.log2("size")).alias("weight"))
    heads = members.join(weight, "class").groupBy("key").agg(F.max_by("class", F.struct("weight", "class")).alias("y"))
    alike = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    sizes = classes.select(F.col("class").alias("y"), F.col("n").alias("m"))
    star = members.join(heads, "key").select("class", "n", "y").filter("class <> y").distinct()
    star = star.join(sizes, "y").filter(alike).select(F.least("class", "y").alias("x"), F.greatest("class", "y").alias("y")).distinct()
    tried = materialize(_close(star, classes, distance), "stars-tried")
    wanted = tried.select(F.col("x").alias("class")).union(tried.select("y")).distinct()
    found = components(_linked(_texts(docs, wanted.join(reps, "class"), n), tried, n, percent))
    let_go(docs.sparkSession)

    # what the stars may have missed: links between components that share a bucket
    labelled = members.join(found.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    split = labelled.groupBy("key").agg((F.min("label") < F.max("label")).alias("split")).filter("split").select("key")
    open_ = materialize(labelled.join(split, "key").groupBy("class", "label", "n").agg(F.lit(1).alias("one")), "open")
    texts = _texts(docs, open_.select("class").join(reps, "class"), n)
    held = materialize(_prefixes(texts, n, percent).join(open_, "class"), "prefixes")
    # if this is the first they share, what is left of either set must hold all that a link needs
    need = percent * (F.col("n") + F.col("m"))
    enough = ((F.col("n") - F.col("at")) * (100 + percent) >= need) & ((F.col("m") - F.col("there")) * (100 + percent) >= need)
    ordered = F.least("class", "y").alias("x"), F.greatest("class", "y").alias("y")

    # one class a shingle first, which has the fewest rarer ones and so is closest to what its group shares
    central = held.groupBy("shingle").agg(F.min_by(F.struct("class", "n", "label", "at"), F.struct("at", "class")).alias("c"), (F.min("label") < F.max("label")).alias("split")).filter("split")
    central = central.select("shingle", F.col("c.class").alias("y"), F.col("c.n").alias("m"), F.col("c.label").alias("other"), F.col("c.at").alias("there"))
    near = held.join(central, "shingle").filter((F.col("label") != F.col("other")) & alike & enough).select(*ordered).distinct().join(tried, ["x", "y"], "left_anti")
    near = materialize(near, "central-tried")
    found = components(_linked(texts, near, n, percent), found)
    tried = tried.unionByName(near)
    held = held.drop("label").join(found.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    held = materialize(held, "relabelled")
    let_go(docs.sparkSession)

    # then all that share a shingle and are still in different components
    own = held.groupBy("shingle", "label").agg(F.count("*").alias("own"))
    split = own.groupBy("shingle").agg(F.max_by("label", F.struct("own", "label")).alias("main"), F.count("*").alias("labels")).filter("labels > 1").select("shingle", "main")
    held = held.join(split, "shingle")
    rest = held.filter("label <> main").select("shingle", "class", "n", "label", "at")
    others = held.select("shingle", F.col("class").alias("y"), F.col("n").alias("m"), F.col("label").alias("other"), F.col("at").alias("there"))
    cross = rest.join(others, (rest["shingle"] == others["shingle"]) & (rest["label"] != others["other"]) & alike & enough)
    cross = cross.select(*ordered).distinct().join(tried, ["x", "y"], "left_anti")
    cross = materialize(cross, "cross-tried")
    found = components(_linked(texts, cross, n, percent), found)

    label = reps.join(found.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    return materialize(label, "labels")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for each row; linked are sets whose Jaccard similarity is ``percent`` / 100 or more."""
    signed = _signed(docs, n, percent)
    label = _labels(docs, signed, n, percent)
    # the smallest doc_id of each component, and of each class outside any
    smallest = label.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = label.join(smallest, "label").select("class", "component_id")
    rows = signed.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: its smallest ``doc_id``, and of that id's sets one. Rows that repeat
    a ``doc_id`` are judged each by its own text; those whose sets are equal stay or go together, and rows of a null
    ``doc_id`` stay."""
    digest = free("_digest", docs.columns)
    signed = _signed(docs, n, percent, F.xxhash64(text_or_empty()).alias(digest))
    label = _labels(docs, signed, n, percent)
    staying = label.groupBy("label").agg(F.min(F.struct("doc_id", "class")).alias("stays"))
    named = label.join(staying, "label").select("class", "stays")
    rows = signed.filter("doc_id is not null").select("doc_id", digest, "class").join(named, "class")
    gone = rows.filter((F.col("class") != F.col("stays.class")) | (F.col("doc_id") != F.col("stays.doc_id"))).select("doc_id", digest).distinct()
    own = docs.withColumn(digest, F.xxhash64(text_or_empty()))
    return own.join(gone, ["doc_id", digest], "left_anti").select(*docs.columns)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), 3, 85)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c ON node = doc_id
"""
