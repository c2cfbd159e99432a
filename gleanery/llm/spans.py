"""Positions of regex matches in DataFrame operations only.

Spark has no function that gives where every match starts. The pieces between the
matches (``split``) and the matches (``regexp_extract_all``), added up by doubling, do:
n matches cost n log n steps, so a log file in one row is no obstacle.
Patterns use possessive quantifiers and a look-behind so that no text, however long
or monotonous, makes the JVM's matcher recurse or rescan a run of characters; each
says the same as the plain pattern it stands for. Positions are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,hit:string,sub:string>"


def sums(xs: Column) -> Column:
    """Running sums of an array of ints, by doubling: each round adds what stands 1, 2, 4, ... places before, so n values take n log n steps."""
    steps = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(xs))).cast("int") - 1, F.lit(0))), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(steps, xs, lambda done, k: F.transform(done, lambda x, i: x + F.when(i >= k, F.get(done, i - k)).otherwise(0)))


def _once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, regex: str, group: int = 0) -> Column:
    """``array<struct<s, e, hit, sub>>`` of all leftmost matches; ``sub`` is the group asked for."""
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.split(text, regex, -1)  # one more than there are matches
    sized = lambda h, g: F.struct(h.alias("hit"), (F.char_length(g) + F.char_length(h)).alias("n"))
    parts = F.filter(F.zip_with(hits, gaps, sized), lambda p: p["hit"].isNotNull())

    def placed(ps: Column) -> Column:
        ends = sums(F.transform(ps, lambda p: p["n"]))
        spans = F.zip_with(ps, ends, lambda p, e: F.struct((e - F.char_length(p["hit"])).alias("s"), e.alias("e"), p["hit"].alias("hit"), p["hit"].alias("sub")))
        if not group:
            return spans
        subs = F.regexp_extract_all(text, F.lit(regex), F.lit(group))
        return F.zip_with(spans, subs, lambda x, sub: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["hit"].alias("hit"), sub.alias("sub")))

    return F.when(text.rlike(regex), _once(parts, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def kinds(found: Column, kind: str, order: int) -> Column:
    """The spans as ``struct<s, o, e, kind>``, which sort by start, then order."""
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def touches(x: Column, spans: Column) -> Column:
    """Whether span ``x`` overlaps one of ``spans``, which are in order and apart from one another: by halving, so n spans take log n steps."""
    steps = F.transform(F.sequence(F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))
    before = F.aggregate(steps, F.lit(0), lambda n, k: F.when(F.get(spans, n + k - 1)["e"] <= x["s"], n + k).otherwise(n))
    return F.coalesce(F.get(spans, before)["s"] < x["e"], F.lit(False))
