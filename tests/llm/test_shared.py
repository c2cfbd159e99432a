import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import arrays
from gleanery.llm.common import free, materialize, trim, work_dir
from gleanery.llm.components import components


def test_words_are_those_of_bytes_split():
    rng = random.Random(1)
    texts = [None, "", " ", *["".join(rng.choices("aBé \t\n\x0b  !", k=rng.randrange(1, 60))) for _ in range(300)]]
    data, at = arrays.column_bytes(pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    seen: dict = {}
    for a, b, some, own in arrays.chunks(data, at, 500):
        h, first = arrays.word_hashes(some, own)
        for k in range(a, b):
            mine = h[first[k - a] : first[k - a + 1]].tolist()
            assert len(mine) == len(want[k])
            for x, w in zip(mine, want[k], strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_sliced_columns_and_stretches():
    column = pa.array(["xx", "abcabc", None, "abc"]).slice(1)
    data, at = arrays.column_bytes(column)
    assert bytes(data) == b"abcabcabc" and at.tolist() == [0, 6, 6, 9]
    sums = arrays.running(data)
    h = arrays.stretch(sums, np.array([0, 3, 6, 1]), np.array([3, 6, 9, 4]))
    assert h[0] == h[1] == h[2] != h[3]
    assert arrays.ragged(np.array([5, 0]), np.array([2, 3])).tolist() == [5, 6, 0, 1, 2]


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for x in up:
        assert got.get(x, x) == root(x)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_go_on_from_those_known(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    frame = lambda some: spark.createDataFrame(some, "a long, b long")
    flat = lambda df: sorted((r.node, r.label) for r in df.collect())
    first = components(frame(edges[:200]))
    assert flat(components(frame(edges[200:]), first)) == flat(components(frame(edges))) != flat(first)
    assert components(frame([]), first) is first


def test_driver_gives_back_native_memory(spark):
    runtime = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getRuntimeMXBean()
    if int(runtime.getSpecVersion()) < 17 or "linux" not in sys.platform:
        pytest.skip("this JVM has no such command")
    assert "Trim native heap" in trim(spark)


def test_tables_go_to_the_shared_folder(spark):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialize(spark.range(5), "t")
    assert df.count() == 5 and work_dir(spark) in df.inputFiles()[0]
    assert free("_a", ["_A", "_a_"]) == "_a__"


def test_span_positions_grow_no_faster_than_the_matches(spark):
    import time

    from pyspark.sql import functions as F

    from gleanery.llm.spans import matches, touches

    def seconds(n):
        df = spark.createDataFrame([("7.é" * n,)], "t string").select(matches(F.col("t"), "[0-9]+").alias("m"))
        df = df.select("m", F.filter("m", lambda x: touches(x, F.col("m"))).alias("hit"))
        began = time.time()
        r = df.collect()[0]
        assert [x.s for x in r.m] == list(range(0, 3 * n, 3)) and len(r.hit) == n
        return time.time() - began

    seconds(1000)
    few = seconds(10_000)
    assert seconds(80_000) < 12 * max(few, 0.5)


def test_touching_spans(spark):
    from pyspark.sql import functions as F

    from gleanery.llm.spans import touches

    spans = [(2, 4), (4, 6), (9, 12)]
    rows = [(s, e, spans[:k]) for s in range(14) for e in range(s + 1, 15) for k in range(4)]
    df = spark.createDataFrame(rows, "s int, e int, b array<struct<s:int,e:int>>").select("*", touches(F.struct("s", "e"), F.col("b")).alias("hit"))
    for r in df.collect():
        assert r.hit == any(r.s < b.e and b.s < r.e for b in r.b), r


def test_no_local_folder_beside_a_cluster():
    import pytest

    class Conf(dict):
        def getConf(self):
            return self

    class Session:
        conf = Conf()
        sparkContext = Conf()

    Session.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        work_dir(Session)
