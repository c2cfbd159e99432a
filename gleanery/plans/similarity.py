"""Similarity search over ``embeddings``: vec_id is a face or object, label its image or person."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector
from ..operators import clustering, descriptors, evaluation, knn, pairs, ranking
from .registry import query, table

#: Similarities of the test vectors are low; every threshold is a parameter.
THRESHOLD, K = 0.25, 10

UNIT = """
unit AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, q.label AS query_label, e.vec_id AS id, e.label, list_cosine_similarity(q.v, e.v) AS score
          FROM unit q JOIN unit e ON true WHERE {which})
"""
EVERY_20TH = "q.vec_id % 20 = 0"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def every_20th(v: DataFrame) -> DataFrame:
    return v.filter("id % 20 = 0")


def labelled(found: DataFrame, v: DataFrame) -> DataFrame:
    return found.join(v.select("id", "label"), "id")


def r(c, n: int = 6):
    return F.round(c, n)


@query(f"WITH {UNIT.format(which=EVERY_20TH)}, {RANKED} SELECT query_id, id, rank, round(score, 6) AS score FROM ranked WHERE rank <= {K}")
def knn_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn.search(v, every_20th(v), k=K).select("query_id", "id", "rank", r("score").alias("score"))


@query(
    f"""WITH {UNIT.format(which=EVERY_20TH)}, best AS (SELECT query_id, label, id, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS n FROM pairs WHERE score >= {THRESHOLD})
    SELECT query_id, label, id, round(score, 6) AS score FROM best WHERE n = 1"""
)
def knn_threshold_person(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = labelled(knn.search(v, every_20th(v), least=THRESHOLD), v)
    return knn.best_per_group(found, "label").select("query_id", "label", "id", r("score").alias("score"))


@query(
    f"""WITH {UNIT.format(which=EVERY_20TH)}, {RANKED}, best AS (SELECT query_id, label, max(score) AS score FROM ranked WHERE rank <= {3 * 5} AND score > 0 GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank FROM best)
    SELECT query_id, label, rank, round(score, 6) AS score FROM top WHERE rank <= 5"""
)
def object_coarse_vote(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = labelled(knn.search(v, every_20th(v), k=15), v)
    return ranking.coarse_objects(found, "label", 5).select("query_id", "label", "rank", r("score").alias("score"))


@query(
    f"""WITH {UNIT.format(which=EVERY_20TH)}, {RANKED}, best AS (SELECT query_id, label, max(greatest(score, 0)) AS best FROM ranked WHERE rank <= 50 GROUP BY ALL)
    SELECT label, round(sum(best), 6) AS votes, count(*) AS n_patches FROM best GROUP BY label"""
)
def patch_coarse_vote(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = labelled(knn.search(v, every_20th(v), k=50), v)
    return ranking.coarse_patches(found, "label").select("label", r("votes").alias("votes"), "n_patches")


MEANS = """
each AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
means AS (SELECT label, dim, avg(x) AS x, count(*) AS n FROM each GROUP BY ALL),
proto AS (SELECT label, n, dim, CASE WHEN n = 1 THEN x ELSE x / sqrt(sum(x * x) OVER (PARTITION BY label)) END AS value FROM means)
"""


@query(f"WITH {MEANS} SELECT label, n, dim, round(value, 6) AS value FROM proto")
def prototype_per_label(spark, sf_dir):
    p = vector.prototypes(vectors(spark, sf_dir), "label", "vector")
    return p.select("label", "n", F.posexplode("prototype").alias("dim", "value")).select("label", "n", "dim", r("value").alias("value"))


@query(
    f"""WITH {MEANS}, p AS (SELECT label AS prototype, list(value ORDER BY dim) AS v FROM proto GROUP BY label),
    s AS (SELECT prototype, vec_id AS id, list_cosine_similarity(v, CAST(embedding AS DOUBLE[])) AS score FROM p JOIN embeddings ON true),
    t AS (SELECT *, row_number() OVER (PARTITION BY prototype ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.2)
    SELECT prototype, id, rank, round(score, 6) AS score FROM t WHERE rank <= 50"""
)
def prototype_search(spark, sf_dir):
    v = vectors(spark, sf_dir)
    p = vector.prototypes(v, "label", "vector").select(F.col("label").cast("long").alias("id"), F.col("prototype").alias("vector"))
    return knn.search(v, p, k=50, least=0.2).select(F.col("query_id").cast("int").alias("prototype"), "id", "rank", r("score").alias("score"))


@query(
    """WITH f AS (SELECT label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS v FROM embeddings GROUP BY label)
    SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM f a JOIN f b ON a.label < b.label"""
)
def pair_similarity_matrix(spark, sf_dir):
    """The first face of each image against each other image's, for a choice of images whose number is checked."""
    f = vectors(spark, sf_dir).groupBy("label").agg(F.min_by("vector", "id").alias("v"))
    both = pairs.of_chosen(f, "label")
    return both.select(F.col("label").alias("a"), F.col("label2").alias("b"), r(vector.cosine(F.col("v"), F.col("v2"))).alias("similarity"))


@query(
    """WITH s AS (SELECT label, vec_id, list_sum(CAST(embedding AS DOUBLE[])) AS total, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high, list_avg(CAST(embedding AS DOUBLE[])) AS mean FROM embeddings)
    SELECT vec_id, round(total, 6) AS total, round(low, 6) AS low, round(high, 6) AS high, round(mean, 6) AS mean,
           coalesce(abs(total - lag(total) OVER (PARTITION BY label ORDER BY vec_id)) < 0.01, false) AS near_previous FROM s"""
)
def vector_stats_lag(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("total", vector.total(F.col("vector")))
    before = F.lag("total").over(Window.partitionBy("label").orderBy("id"))
    return v.select(
        F.col("id").alias("vec_id"), r("total").alias("total"), r(F.array_min("vector").cast("double")).alias("low"), r(F.array_max("vector").cast("double")).alias("high"),
        r(F.col("total") / F.size("vector")).alias("mean"), F.coalesce(F.abs(F.col("total") - before) < 0.01, F.lit(False)).alias("near_previous"),
    )


@query(
    f"""WITH {UNIT.format(which="q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id")}, {RANKED},
    votes AS (SELECT query_id, label AS person_id, count(*) AS votes, sum(score) AS total, max(score) AS top FROM ranked WHERE rank <= {K} GROUP BY ALL),
    w AS (SELECT *, max(top) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, total DESC, person_id) AS n FROM votes)
    SELECT query_id, person_id, votes, round(total, 6) AS total FROM w WHERE n = 1 AND best >= {THRESHOLD}"""
)
def knn_person_vote(spark, sf_dir):
    v = vectors(spark, sf_dir)
    found = knn.search(v, every_20th(v), k=K + 1).filter("id <> query_id")
    near = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("n") <= K)
    votes = clustering.vote(labelled(near, v).withColumnRenamed("label", "person_id"), THRESHOLD)
    return votes.select("query_id", "person_id", "votes", r("total").alias("total"))


CENTROIDS = "c AS (SELECT label AS k, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS c FROM embeddings GROUP BY label)"
ASSIGNED = f"""{CENTROIDS},
d AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, k, c, list_distance(CAST(embedding AS DOUBLE[]), c) ** 2 AS distance FROM embeddings JOIN c ON true),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 12), k) AS n FROM d) WHERE n = 1)"""


def _centroids(v: DataFrame) -> DataFrame:
    """Fixed centroids: each label's first vector."""
    return v.groupBy(F.col("label").alias("k")).agg(F.min_by("vector", "id").alias("centroid"))


@query(f"WITH {ASSIGNED} SELECT vec_id, k, round(distance, 6) AS distance FROM a")
def vlad_assign(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return descriptors.assign(v, _centroids(v)).select(F.col("id").alias("vec_id"), "k", r("distance").alias("distance"))


@query(
    f"""WITH {ASSIGNED}, e AS (SELECT label, k, generate_subscripts(v, 1) - 1 AS dim, unnest(v) - unnest(c) AS x FROM a), s AS (SELECT label, k, dim, sum(x) AS x FROM e GROUP BY ALL)
    SELECT label, k, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) + 0 AS value FROM s"""
)
def vlad_residual(spark, sf_dir):
    v = vectors(spark, sf_dir)
    c = _centroids(v)
    return descriptors.vlad(descriptors.assign(v, c), c, "label").select("label", "k", "dim", (r("value") + 0.0).alias("value"))


@query(
    """WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)
    SELECT label, dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS spread FROM e GROUP BY ALL"""
)
def descriptor_mean_std(spark, sf_dir):
    each = vectors(spark, sf_dir).select("label", F.posexplode(vector.doubles(F.col("vector"))).alias("dim", "x"))
    return each.groupBy("label", "dim").agg(r(F.avg("x")).alias("mean"), r(F.stddev_pop("x")).alias("spread"))


@query(
    """WITH u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT a.label AS image, b.label AS other, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS score FROM u a JOIN u b ON a.label % 20 = 0 AND b.label <> a.label),
    t AS (SELECT *, row_number() OVER (PARTITION BY a, other ORDER BY score DESC, b) AS x, row_number() OVER (PARTITION BY b, image ORDER BY score DESC, a) AS y FROM s)
    SELECT image, other, a, b, round(score, 6) AS score FROM t WHERE x = 1 AND y = 1 AND score >= 0.1"""
)
def mutual_nn_match(spark, sf_dir):
    """Descriptors of each image whose number is divisible by 20 against those of every other image: pairs that are each other's nearest, image by image."""
    v = vectors(spark, sf_dir)
    queries = v.filter("label % 20 = 0")
    # a pair under the least similarity is no result, nor does it displace one, so only those that reach it are compared
    found = labelled(knn.search(v, queries, least=0.1), v).withColumnRenamed("label", "other")
    found = found.join(queries.select(F.col("id").alias("query_id"), F.col("label").alias("image")), "query_id").filter("image <> other")
    best = lambda of: F.max_by(of, F.struct("score", -F.col(of)))
    forth = found.groupBy("image", "other", F.col("query_id").alias("a")).agg(best("id").alias("b"), F.max("score").alias("score"))
    back = found.groupBy("image", "other", F.col("id").alias("b")).agg(best("query_id").alias("a"))
    return forth.join(back, ["image", "other", "a", "b"]).select("image", "other", "a", "b", r("score").alias("score"))


RUN = f"""{UNIT.format(which="q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id")}, {RANKED},
rel AS (SELECT q.vec_id AS query, count(*) AS n FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
per AS (SELECT rel.query, {", ".join(f"count(*) FILTER (rank <= {k} AND label = query_label) / greatest(any_value(n), 1) AS recall_{k}" for k in evaluation.KS)},
        coalesce(1.0 / min(rank) FILTER (label = query_label), 0) AS reciprocal_rank, coalesce(min(rank) FILTER (label = query_label) = 1, false) AS top_1,
        count(*) FILTER (label = query_label) > 0 AS covered
        FROM rel JOIN ranked ON query_id = query AND rank <= 20 GROUP BY rel.query)"""


def _run(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir)
    q = every_20th(v)
    found = knn.search(v, q, k=21).filter("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    run = found.select(F.col("query_id").alias("query"), rank.alias("rank"), F.col("id").alias("candidate")).filter("rank <= 20")
    own = v.select(F.col("id").alias("candidate"), "label")
    relevant = q.select(F.col("id").alias("query"), "label").join(own, "label").filter("query <> candidate").select("query", "candidate")
    return evaluation.per_query(run, relevant)


@query(f"WITH {RUN} SELECT query, {', '.join(f'round(recall_{k}, 6) AS recall_{k}' for k in evaluation.KS)}, covered FROM per")
def recall_at_k(spark, sf_dir):
    return _run(spark, sf_dir).select("query", *[r(f"recall_{k}").alias(f"recall_{k}") for k in evaluation.KS], "covered")


@query(
    f"""WITH {RUN} SELECT count(*) AS n_queries, {", ".join(f"round(avg(recall_{k}), 6) AS recall_{k}" for k in evaluation.KS)}, round(avg(reciprocal_rank), 6) AS mrr,
    round(avg(top_1::INT), 6) AS top_1_accuracy, round(avg(covered::INT), 6) AS coverage FROM per"""
)
def mrr(spark, sf_dir):
    s = evaluation.summary(_run(spark, sf_dir))
    return s.select("n_queries", *[r(c).alias(c) for c in s.columns[1:]])


@query()
def cluster_online(spark, sf_dir):
    return clustering.online(vectors(spark, sf_dir), "label", THRESHOLD, K)


@query()
def kmeans_fit(spark, sf_dir):
    model = descriptors.kmeans(vectors(spark, sf_dir), 8)
    return spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())], "k int, centroid array<double>")


@query()
def lsh_ann(spark, sf_dir):
    v = vectors(spark, sf_dir)
    model, own = clustering.lsh(v)
    near = model.approxSimilarityJoin(own, own.filter("id % 20 = 0"), 1.2, "distance")
    return near.select(F.col("datasetB.id").alias("query_id"), F.col("datasetA.id").alias("id"), "distance")
