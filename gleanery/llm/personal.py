"""Personal data by candidate gradient boosting, in DataFrame operations only.

Strict patterns with their checks (parts, digits, Luhn) give the base spans. Beside
them, high-recall generators propose overlapping candidates: obfuscated addresses,
groups of digits of any layout, addresses of eight groups. Each candidate has flags for
its format and context. Boosted trees learn from the corpus itself which flags go with
spans that passed a strict check: the flags that the checks decide are left out, so
that the trees judge the rest by layout and the words before. Texts fall into two folds
by their content, copies together. Each fold's candidates are judged by the trees of the
other, and per kind of candidate the threshold is set on those held-out scores. What
reaches it is added; a candidate over a base span adds nothing.

The flags are few, so that all candidates of the corpus fold into at most
2 * len(MORE) * 2**len(FLAGS) counted rows, whatever its size; the trees are fitted on
those counts exactly, without a sample, and scored as a sum of CASE expressions.

Defined results: a null text is empty and has no spans; repeated rows get the same
spans each; null ids are kept; spans of different kinds may overlap; with no positive
candidate nothing is added; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, text_or_empty
from .spans import kinds, matches, touches, written

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BASE = {"email": 0, "ip": 1, "card": 2, "phone": 3}

ADDRESS_LIKE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]{1,63}){1,8}"
DIGITS = r"(?<![0-9A-Za-z+(])[+(]{0,2}[0-9][0-9\x20().-]{5,28}[0-9](?![0-9A-Za-z])"
GROUPS = r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"
MORE = {"address_like": 4, "digits": 5, "groups": 6}

CUE = r"(?i:phone|tel|call|mobile|fax|contact|mail|card|visa|iban|account|ssn|social|passport|born|address|server|host|ip)[^A-Za-z]{0,4}(?:[A-Za-z]{1,8}[^A-Za-z]{1,3})?$"
LEFT = 32
FLAGS = ("cue", "spaced", "bracketed", "at", "dotted", "dashed", "long", "short", "even_groups", "marked_left", "groups_of_hex")

ROUNDS, RATE, PRECISION, LEAST = 30, 0.3, 0.95, 20


def _luhn(hit: Column) -> Column:
    digits = F.transform(F.split(F.reverse(F.regexp_replace(hit, "[^0-9]", "")), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    each = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _count(hit: Column) -> Column:
    return F.char_length(F.regexp_replace(hit, "[^0-9]", ""))


def _flags(text: Column, x: Column, hex_groups: bool) -> Column:
    hit = x["hit"]
    before = F.substring(text, F.greatest(x["s"] - LEFT + 1, F.lit(1)), F.least(x["s"], F.lit(LEFT)))
    n = _count(hit)
    tests = (
        before.rlike(CUE),
        hit.contains(" "),
        hit.rlike(r"[()\[]"),
        hit.rlike(r"@|\[at\]|\(at\)"),
        hit.contains("."),
        hit.contains("-"),
        n >= 13,
        n <= 8,
        hit.rlike(r"^[+(]{0,2}[0-9]{1,4}(?:[ .()-]{1,2}[0-9]{2,4}){2,4}$"),
        before.rlike(r"[=:#$*&%|/]\x20?$"),
        F.lit(hex_groups),
    )
    out = F.lit(0)
    for k, t in enumerate(tests):
        out = out + F.when(t, 1 << k).otherwise(0)
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), out.alias("flags"))


def _candidates(docs: DataFrame) -> DataFrame:
    text = F.col("_text")
    card = matches(text, CARD)
    found = docs.select("doc_id", text_or_empty().alias("_text")).select(
        "doc_id",
        "_text",
        F.pmod(F.xxhash64("_text"), F.lit(2)).cast("int").alias("fold"),
        kinds(matches(text, EMAIL), "email", 0).alias("email"),
        kinds(F.filter(matches(text, IP), lambda x: x["hit"].rlike(rf"^{PART}(?:\.{PART}){{3}}$")), "ip", 1).alias("ip"),
        kinds(F.filter(card, lambda x: _count(x["hit"]).between(13, 19) & _luhn(x["hit"])), "card", 2).alias("card"),
        kinds(F.filter(matches(text, PHONE), lambda x: _count(x["hit"]).between(9, 15)), "phone", 3).alias("phone"),
        F.transform(matches(text, ADDRESS_LIKE), lambda x: _flags(text, x, False)).alias("address_like"),
        F.transform(matches(text, DIGITS), lambda x: _flags(text, x, False)).alias("digits"),
        F.transform(matches(text, GROUPS), lambda x: _flags(text, x, True)).alias("groups"),
    )
    return found.drop("_text")


def fit_trees(counts: list[tuple[int, float, float]]) -> tuple[float, list[tuple[int, int, int, tuple[float, float, float, float]]]]:
    """Gradient boosting on (flags, positives, negatives): the start and trees (root flag, flag if unset, flag if set, leaf values 00 01 10 11)."""
    pos, neg = sum(c[1] for c in counts), sum(c[2] for c in counts)
    start = math.log((pos + 1) / (neg + 1))
    margin = {c[0]: start for c in counts}
    trees = []

    def gain(rows, k):
        out, leaves = 0.0, []
        for side in (0, 1):
            g = h = 0.0
            for f, p, n in rows:
                if f >> k & 1 == side:
                    q = 1 / (1 + math.exp(-margin[f]))
                    g += p * (1 - q) - n * q
                    h += (p + n) * q * (1 - q)
            out += g * g / (h + 1)
            leaves.append(RATE * g / (h + 1))
        return out, leaves

    def best(rows):
        return max(((*gain(rows, k), k) for k in range(len(FLAGS))), key=lambda x: (x[0], -x[2]))

    for _ in range(ROUNDS if pos and neg else 0):
        root = max(range(len(FLAGS)), key=lambda k: (sum(best([c for c in counts if c[0] >> k & 1 == s])[0] for s in (0, 1)), -k))
        (_, low, a), (_, high, b) = (best([c for c in counts if c[0] >> root & 1 == s]) for s in (0, 1))
        leaves = (*low, *high)
        trees.append((root, a, b, leaves))
        for f in margin:
            side = f >> root & 1
            margin[f] += leaves[2 * side + (f >> (b if side else a) & 1)]
    return start, trees


def score(model: tuple, flags: int) -> float:
    start, trees = model
    return start + sum(leaves[2 * (s := flags >> root & 1) + (flags >> (b if s else a) & 1)] for root, a, b, leaves in trees)


def _score(model: tuple, flags: Column) -> Column:
    out, bit = F.lit(model[0]), lambda k: flags.bitwiseAND(1 << k) != 0
    for root, a, b, leaves in model[1]:
        low = F.when(bit(a), leaves[1]).otherwise(leaves[0])
        out = out + F.when(bit(root), F.when(bit(b), leaves[3]).otherwise(leaves[2])).otherwise(low)
    return out


def threshold(judged: list[tuple[float, float, float]]) -> float:
    """Of (score, positives, negatives): the lowest score at and above which candidates passed a strict check with at least PRECISION, and LEAST of them or more; infinite if none.

    Equal scores go together, as no threshold tells them apart."""
    found, p, n = math.inf, 0.0, 0.0
    by_score: dict[float, list[float]] = {}
    for s, pos, neg in judged:
        own = by_score.setdefault(s, [0.0, 0.0])
        own[0] += pos
        own[1] += neg
    for s in sorted(by_score, reverse=True):
        p, n = p + by_score[s][0], n + by_score[s][1]
        if p >= LEAST and p / (p + n) >= PRECISION:
            found = s
    return found


def _added_up(counts) -> list[tuple[int, float, float]]:
    out: dict[int, list[float]] = {}
    for flags, p, n in counts:
        own = out.setdefault(flags, [0.0, 0.0])
        own[0] += p
        own[1] += n
    return [(f, *out[f]) for f in sorted(out)]


def thresholds(models: list[tuple], counts: list[tuple[int, int, int, float, float]]) -> dict[int, float]:
    """For each kind of candidate, the threshold at which those that the model of the other fold judged are good enough.

    ``counts``: (fold, kind, flags, positives, negatives); ``models[fold]`` was fitted without that fold."""
    out = {}
    for kind in MORE.values():
        judged = [(score(models[fold], flags), p, n) for fold, k, flags, p, n in counts if k == kind]
        out[kind] = threshold(judged)
    return out


def find_personal(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the counts, and the arrays ``base`` and ``added`` of ``struct<s, o, e, kind>``."""
    rows = materialize(_candidates(docs), "personal")
    over = lambda x: functools.reduce(or_, [touches(x, F.col(k)) for k in BASE])

    def judged(kind: str, order: int) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(order).alias("kind"), x["flags"].alias("flags"), over(x).alias("good")))

    seen = [judged(k, o) for k, o in MORE.items()]
    each = rows.select("fold", F.explode(F.concat(*seen)).alias("x")).groupBy("fold", "x.kind", "x.flags").agg(F.sum(F.col("x.good").cast("long")).alias("p"), F.count("*").alias("n"))
    counts = [(r.fold, r.kind, r.flags, float(r.p), float(r.n - r.p)) for r in each.orderBy("fold", "kind", "flags").collect()]  # at most 2 * len(MORE) * 2**len(FLAGS) rows
    models = [fit_trees(_added_up(c[2:] for c in counts if c[0] != fold)) for fold in (0, 1)]
    least = thresholds(models, counts)

    def added(kind: str, order: int) -> Column:
        if least[order] == math.inf:
            return kinds(F.filter(F.col(kind), lambda x: F.lit(False)), kind, order)
        good = lambda x: F.when(F.col("fold") == 0, _score(models[0], x["flags"])).otherwise(_score(models[1], x["flags"])) >= least[order] - 1e-9
        return kinds(F.filter(F.col(kind), lambda x: good(x) & ~over(x)), kind, order)

    more = F.concat(*[added(k, o) for k, o in MORE.items()])
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.concat(*BASE).alias("base"), F.array_distinct(more).alias("added"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal(read(spark, sf_dir, "documents"))
    by_kind = lambda xs: F.array_sort(xs, lambda a, b: F.when(a["o"] != b["o"], a["o"] - b["o"]).otherwise(a["s"] - b["s"]))
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in BASE],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(by_kind(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
