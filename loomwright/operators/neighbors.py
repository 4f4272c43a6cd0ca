"""Nearest neighbours by squared Euclidean distance, exact, with a query set taken in bounded blocks.

One side (heads) is cut into blocks of at most ``block`` rows. Each block is sent to all partitions of the other side as
a matrix, which keeps its best so far; a block's size is bounded by ``block``, whatever the data. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import durable, new_path

BLOCK = 20_000
#: Distances of this many pairs are held at once.
PAIRS = 1 << 22


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _blocks(heads: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of at most about ``block`` heads each, by a hash of the id."""
    held = durable(heads, "heads")
    n = held.count()
    parts = -(-n // block)
    for k in range(parts):
        found = held.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).select(F.col("id").cast("bigint"), F.col("v").cast("array<double>")).toArrow()
        if found.num_rows:
            ids = found.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            yield ids[order], _matrix(found.column("v").combine_chunks())[order]


def _scan(points: DataFrame, body: Callable[[np.ndarray, np.ndarray], list], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([pa.array(c) for c in body(np.asarray(batch.column(0), np.int64), _matrix(batch.column(1)))], names=names)

    return points.select(F.col("id").cast("bigint"), "v").mapInArrow(run, schema)


def nearest(points: DataFrame, heads: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, head, distance): the nearest head of each point; points and heads are (id, v). Without heads: no rows."""
    found = None
    for ids, vectors in _blocks(heads, block):

        def best(point_ids, x, ids=ids, vectors=vectors):
            head, distance = np.empty(len(x), np.int64), np.empty(len(x))
            step = max(1, PAIRS // (len(ids) * max(x.shape[1], 1)))
            for a in range(0, len(x), step):
                d = ((x[a : a + step, None, :] - vectors[None]) ** 2).sum(axis=2)
                k = d.argmin(axis=1)  # ids ascend, so the first of equal ones has the smallest
                head[a : a + step], distance[a : a + step] = ids[k], d[np.arange(len(k)), k]
            return [point_ids, head, distance]

        one = _scan(points, best, "id bigint, head bigint, distance double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return points.select(F.col("id").cast("bigint"), F.col("id").cast("bigint").alias("head"), F.lit(0.0).alias("distance")).filter("false")
    return found.groupBy("id").agg(F.min(F.struct("distance", "head")).alias("b")).select("id", F.col("b.head").alias("head"), F.col("b.distance").alias("distance"))


def cluster_heads(negatives: DataFrame, positives: DataFrame, k: int) -> DataFrame:
    """(id, n): the k positives that are nearest to most negatives, ties to the smaller id, in order of id."""
    n = nearest(negatives, positives).groupBy(F.col("head").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "id").limit(k).orderBy("id")


def k_nearest(points: DataFrame, centre: list[float], k: int) -> DataFrame:
    """(id, distance): the k points nearest to a vector."""
    distance = squared_distance(F.col("v"), F.array(*map(F.lit, map(float, centre))))
    return points.select("id", F.round(distance, 9).alias("distance")).orderBy("distance", "id").limit(k)


def centroid(points: DataFrame) -> list[float]:
    rows = points.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("pos").collect()
    return [r["m"] for r in rows]


def _beyond(points: DataFrame, ids: np.ndarray, vectors: np.ndarray, centre: np.ndarray) -> DataFrame:
    """(id, least) for each of a block's points i: the least (x_j - x_i) . (c - x_i) over the points j of a batch."""
    towards = centre - vectors
    own = (vectors * towards).sum(axis=1)

    def least(_, x):
        step = max(1, PAIRS // max(len(ids), 1))
        return [ids, np.min([(x[a : a + step] @ towards.T - own).min(axis=0) for a in range(0, len(x), step)], axis=0)]

    return _scan(points, least, "id bigint, least double")


def boundary(points: DataFrame, tolerance: float = 1e-9, block: int = BLOCK, probe: int = 2000) -> DataFrame:
    """(id): points such that all points lie on the centroid's side of them, (x_j - x_i) . (c - x_i) >= 0 for all j.

    All points are first held against ``probe`` of them, which shows most others to lie inside; what is left is held
    against all, a block at a time: the driver holds one block, a worker one and PAIRS products. Where most points are on
    the boundary, as in many dimensions, this is all pairs.
    """
    centre = np.array(centroid(points))
    some = points.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(probe).collect()  # probe rows
    if not some:
        return points.select("id").limit(0)
    known = np.array([r["v"] for r in some], np.float64)

    def inside(batches):
        for batch in batches:
            step = PAIRS // len(known)
            for a in range(0, batch.num_rows, step):
                x = _matrix(batch.column("v").slice(a, step))
                towards = centre - x
                keep = (towards @ known.T - (x * towards).sum(axis=1)[:, None]).min(axis=1) >= -tolerance
                yield batch.slice(a, step).filter(pa.array(keep))

    held = points.select(F.col("id").cast("bigint").alias("id"), F.col("v").cast("array<double>").alias("v"))
    left = durable(held.mapInArrow(inside, held.schema), "edge")
    path = None
    for ids, vectors in _blocks(left, block):
        path = path or new_path(points.sparkSession, "least")
        _beyond(points, ids, vectors, centre).groupBy("id").agg(F.min("least").alias("least")).write.mode("append").parquet(path)
    if path is None:
        return points.select("id").limit(0)
    least = points.sparkSession.read.schema("id bigint, least double").parquet(path)
    return least.groupBy("id").agg(F.min("least").alias("least")).filter(F.col("least") >= -tolerance).select("id")


def some_of(points: DataFrame, most: int = 24) -> DataFrame:
    """At most ``most`` rows, those with the least MD5 of their id: a random subset that is the same on every run, in order of id."""
    return points.orderBy(F.md5(F.col("id").cast("string")), "id").limit(most).orderBy("id")


def numbered(points: DataFrame, per_range: int = BLOCK) -> tuple[DataFrame, int]:
    """points with at, 0 to n - 1, and n: rows are numbered within hash ranges, each starting where those before it end."""
    parts = -(-points.count() // per_range)
    ranged = durable(points.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(parts, 1)))), "ranged")
    # one row for each range of about per_range rows
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    starts = counts.withColumn("start", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found = ranged.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1).join(starts, "part")
    return durable(found.withColumn("at", (F.col("start") + F.col("r")).cast("bigint")).drop("part", "r", "k", "start"), "numbered"), ranged.count()


def pair_distances(points: DataFrame, n_pairs: int, seed: int = 0) -> DataFrame:
    """(draw, a, b, distance) of n_pairs pairs drawn with replacement: each draw picks the rows that two hashes number."""
    rows, size = numbered(points.select("id", "v"))
    draws = F.explode(F.sequence(F.lit(1), F.lit(n_pairs)))
    at = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), "draw"), F.lit(max(size, 1)))
    pick = points.sparkSession.range(1).select(draws.alias("draw")).select("draw", at(2).alias("s"), at(3).alias("t"))
    left, right = (rows.select(F.col("at").alias(x), F.col("id").alias(a), F.col("v").alias(f"v{a}")) for x, a in (("s", "a"), ("t", "b")))
    return pick.join(left, "s").join(right, "t").select("draw", "a", "b", squared_distance(F.col("va"), F.col("vb")).alias("distance"))
