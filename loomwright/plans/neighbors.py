"""Neighbour queries: embeddings of label 0 are the positives, all others the negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import neighbors as N
from loomwright.plans.catalog import query, table

K_HEADS, K_POOL = 5, 50
SIDES_SQL = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), pos AS (SELECT * FROM e WHERE label = 0), neg AS (SELECT * FROM e WHERE label <> 0)"
NEAR_SQL = SIDES_SQL + ", d AS (SELECT n.id, p.id AS head, list_distance(n.v, p.v) ^ 2 AS distance FROM neg n, pos p), near AS (SELECT id, head, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, head) AS r FROM d) WHERE r = 1)"
HEADS_SQL = NEAR_SQL + f", heads AS (SELECT head AS id, count(*) AS n FROM near GROUP BY head ORDER BY n DESC, head LIMIT {K_HEADS})"


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all, positives, negatives) as (id, v)."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    return e.select("id", "v"), e.filter("label = 0").select("id", "v"), e.filter("label <> 0").select("id", "v")


@query("nn_negative_to_positive", f"WITH {NEAR_SQL} SELECT id, head, round(distance, 6) AS distance FROM near")
def nn_negative_to_positive(spark: SparkSession, sf: str) -> DataFrame:
    _, positives, negatives = sides(spark, sf)
    return N.nearest(negatives, positives).withColumn("distance", F.round("distance", 6))


@query("cluster_heads", f"WITH {HEADS_SQL} SELECT id, n FROM heads")
def cluster_heads(spark: SparkSession, sf: str) -> DataFrame:
    _, positives, negatives = sides(spark, sf)
    return N.cluster_heads(negatives, positives, K_HEADS)


@query("head_assignment", f"WITH {HEADS_SQL}, a AS (SELECT e.id, p.id AS head, list_distance(e.v, p.v) ^ 2 AS distance FROM e, pos p WHERE p.id IN (SELECT id FROM heads)) SELECT id, head, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, head) AS r FROM a) WHERE r = 1")
def head_assignment(spark: SparkSession, sf: str) -> DataFrame:
    everything, positives, negatives = sides(spark, sf)
    heads = N.cluster_heads(negatives, positives, K_HEADS).select("id")
    return N.nearest(everything, positives.join(F.broadcast(heads), "id", "left_semi")).withColumn("distance", F.round("distance", 6))  # K_HEADS rows


@query("knn_pool", f"WITH {SIDES_SQL}, c AS (SELECT v FROM pos ORDER BY id LIMIT 1) SELECT n.id, round(round(list_distance(n.v, c.v) ^ 2, 9), 6) AS distance FROM neg n, c ORDER BY round(list_distance(n.v, c.v) ^ 2, 9), n.id LIMIT {K_POOL}")
def knn_pool(spark: SparkSession, sf: str) -> DataFrame:
    _, positives, negatives = sides(spark, sf)
    first = positives.orderBy("id").limit(1).collect()
    if not first:
        return negatives.select("id", F.lit(0.0).alias("distance")).limit(0)
    return N.k_nearest(negatives, first[0]["v"], K_POOL).withColumn("distance", F.round("distance", 6))


BOUNDARY_SQL = f"""WITH {SIDES_SQL}, c AS (SELECT list(m ORDER BY k) AS c FROM (SELECT k, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS k FROM pos) GROUP BY k)),
t AS (SELECT id, v, list_transform(list_zip(c, v), lambda z: z[1] - z[2]) AS w FROM pos, c)
SELECT a.id FROM t a JOIN pos b ON true GROUP BY a.id HAVING min(list_dot_product(b.v, a.w) - list_dot_product(a.v, a.w)) >= -1e-9"""


@query("boundary_points", BOUNDARY_SQL)
def boundary_points(spark: SparkSession, sf: str) -> DataFrame:
    _, positives, _ = sides(spark, sf)
    return N.boundary(positives)


@query("boundary_subset", f"SELECT id FROM ({BOUNDARY_SQL}) ORDER BY md5(id::VARCHAR) LIMIT 24")
def boundary_subset(spark: SparkSession, sf: str) -> DataFrame:
    """At most 24 points of the boundary, drawn by a hash."""
    return N.some_of(boundary_points(spark, sf))


@query("pair_distance_median")
def pair_distance_median(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded sample of pairs: SQL has another generator."""
    everything, _, _ = sides(spark, sf)
    return N.pair_distances(everything, 50_000).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("distance", 0.5), 6).alias("median"))
