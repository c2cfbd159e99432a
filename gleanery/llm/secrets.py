"""Secret scan by multipart credential linking, in DataFrame operations only.

Strong spans (assignments, access ids, long hexadecimal runs) are reported on their
own. Weak candidates - short ids and logins, short or loosely formed secrets,
endpoints - mean little alone; they are reported only where complementary parts
stand within ``SCOPE`` code points of one another: an identifier beside a secret, an
endpoint beside both. The gap counts from the end of one part to the start of the other.
The parts are interval-joined by cells of that width at both ends, so a part meets at
most the parts that end or start in four cells, however long its text or it is.

Defined results: a null text is empty and has no spans; repeated rows get the same
spans each; null ids are kept; overlapping candidates of different kinds are all
parts, but a weak one over a strong span is dropped; an empty table gives no rows.
Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import functools
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, text_or_empty
from .spans import kinds, matches, touches, written

SCOPE = 200

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Where the next part of a connection string begins; a loosely formed value ends before it.
NEXT = r"""[;&,]["']?(?i:access_?key_?id|client_?id|key_?id|username|user|login|host|endpoint|server)["']?\x20*+[:=]"""
WEAK_ID = r"""(?i:access_?key_?id|client_?id|key_?id|username|user|login)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9_.@-]{4,}+|AKIA[A-Z0-9]{8,13}(?![A-Z0-9])"""
WEAK_SECRET = (
    r"""(?i:password|passwd|pwd|passphrase|secret|token|api_?key|private_?key)["']?\x20*+[:=]\x20*+["']?(?:(?!%s)[^\s"']){4,}+"""
    r"""|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"""
) % NEXT
ENDPOINT = r"""(?i:https?|jdbc:[a-z]{2,}+|postgres|mysql|redis|mongodb|amqp)://[A-Za-z0-9.:@_-]{3,}+|(?i:host|endpoint|server)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9.-]{4,}+(?::[0-9]{1,5})?"""

STRONG = {"assign": 0, "access": 1, "hex": 2}
WEAK = {"weak_id": 3, "weak_secret": 4, "endpoint": 5}


def _parts(docs: DataFrame) -> DataFrame:
    """Per row: the strong spans, and the weak candidates that overlap none of them."""
    text = F.col("_text")
    found = docs.select("doc_id", text_or_empty().alias("_text")).select(
        "doc_id",
        "_text",
        kinds(F.filter(matches(text, ASSIGN, 1), lambda x: F.char_length(x["sub"]) >= 12), "assign", 0).alias("assign"),
        kinds(matches(text, ACCESS), "access", 1).alias("access"),
        kinds(matches(text, HEX), "hex", 2).alias("hex"),
        kinds(matches(text, WEAK_ID), "weak_id", 3).alias("weak_id"),
        kinds(matches(text, WEAK_SECRET), "weak_secret", 4).alias("weak_secret"),
        kinds(matches(text, ENDPOINT), "endpoint", 5).alias("endpoint"),
    )
    # an id and a secret at least are needed before anything weak can be linked
    linkable = (F.size("access") + F.size("weak_id") > 0) & (F.size("assign") + F.size("hex") + F.size("weak_secret") > 0)
    return found.select("doc_id", *STRONG, *WEAK, F.when(linkable, F.md5("_text")).alias("digest"))


def _near(a: DataFrame, b: DataFrame) -> DataFrame:
    """Interval semi-join: rows of ``a`` (doc_id, digest, span) that stand apart from a row of ``b`` with a gap of at most SCOPE.

    Where ``a`` comes first (side 0) its end meets the other's start, else its start the other's end; a row may be given once a side."""
    cell = lambda at, d=0: F.floor(at / SCOPE) + d
    place = lambda side, at, d=0: F.struct(F.lit(side).alias("side"), cell(at, d).alias("cell"))
    x, y = F.col("span"), F.col("b_span")
    left = a.withColumn("place", F.explode(F.array(place(0, x["e"]), place(1, x["s"]))))
    right = b.select(F.col("doc_id").alias("b_id"), F.col("digest").alias("b_digest"), F.col("span").alias("b_span"))
    right = right.withColumn("b_place", F.explode(F.array(*[place(0, y["s"], d) for d in (-1, 0)], *[place(1, y["e"], d) for d in (0, 1)])))
    gap = F.when(F.col("place.side") == 0, y["s"] - x["e"]).otherwise(x["s"] - y["e"])
    met = left.join(
        right,
        left["doc_id"].eqNullSafe(right["b_id"]) & (left["digest"] == right["b_digest"]) & (left["place"] == right["b_place"]) & gap.between(0, SCOPE),
        "left_semi",
    )
    return met.drop("place")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id`` and the arrays ``strong`` and ``linked`` of ``struct<s, o, e, kind>``."""
    rows = materialize(_parts(docs), "credential-parts")
    strong = F.array_sort(F.concat(*STRONG))
    some = rows.filter("digest is not null").select("doc_id", "digest", *STRONG, *[_clear(k).alias(k) for k in WEAK]).dropDuplicates(["doc_id", "digest"])

    def part(*names: str) -> DataFrame:
        return some.select("doc_id", "digest", F.explode(F.concat(*names)).alias("span"))

    ids, secrets = part("access", "weak_id"), part("assign", "hex", "weak_secret")
    near_ids, near_secrets = _near(ids, secrets), _near(secrets, ids)
    ends = _near(_near(part("endpoint"), near_ids), near_secrets)
    linked = near_ids.unionByName(near_secrets).unionByName(ends).filter(F.col("span.o") > 2)
    linked = linked.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("span")).alias("linked"))
    linked = linked.select(F.col("doc_id").alias("l_id"), F.col("digest").alias("l_digest"), "linked")
    base = rows.select("doc_id", "digest", strong.alias("strong"), *[F.size(k).cast("long").alias(f"n_{k}") for k in STRONG])
    both = base.join(linked, base["doc_id"].eqNullSafe(linked["l_id"]) & (base["digest"] == linked["l_digest"]), "left")
    return both.select("doc_id", *[f"n_{k}" for k in STRONG], "strong", F.coalesce("linked", F.array_except("strong", "strong")).alias("linked"))


def _clear(kind: str) -> Column:
    free_of = lambda w: ~functools.reduce(or_, [touches(w, F.col(k)) for k in STRONG])
    return F.filter(F.col(kind), free_of)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in STRONG],
        F.sha2(written(F.col("strong")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("strong", "linked"))).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
