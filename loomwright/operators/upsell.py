"""Classifier stacks: balanced forest ensembles, additive spline models with pruning rounds, stacking, one model per cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators import metrics
from loomwright.session import durable

#: Negatives of one local model.
POOL = 8000

def balanced(df: DataFrame, label: str, key: str, sizes: dict[int, int], seed: int) -> DataFrame:
    """About sizes[y] rows of each label y, drawn by a seeded hash; all of them where there are fewer."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*(F.when(F.col(label) == y, F.lit(min(1.0, n / max(counts.get(y, 0), 1)))) for y, n in sizes.items()), F.lit(0.0))
    return df.filter(u < share)


def assembled(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(df)


class Forests:
    """Forests fitted on different balanced draws; their probability is the mean of theirs."""

    def __init__(self, models: list[Model], columns: list[str]):
        self.models, self.columns = models, columns

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], key: str, label: str = "label", forests: int = 6, trees: int = 1000, sizes: dict[int, int] | None = None, seed: int = 0) -> Forests:
        held = assembled(df.select(key, label, *columns), columns)
        models = []
        for k in range(forests):
            part = balanced(held, label, key, sizes or {0: 2700, 1: 1800}, seed + k)
            models.append(RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, seed=seed + k, maxDepth=8).fit(part))
        return cls(models, columns)

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """df with the probability of label 1; 0 where a model knows one class only."""
        held = assembled(df, self.columns)
        names = []
        for k, model in enumerate(self.models):
            made = model.transform(held.drop("rawPrediction", "probability", "prediction"))
            p = F.coalesce(F.get(vector_to_array("probability"), 1), F.lit(0.0)) if model.numClasses > 1 else F.lit(0.0)
            held, names = made.withColumn(f"p_{k}", p), [*names, f"p_{k}"]
        mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
        return held.withColumn(out, mean).drop("features", "rawPrediction", "probability", "prediction", *names)


def spline_basis(x: Column, knots: list[float]) -> list[Column]:
    """Natural cubic basis at ascending knots: the value itself and one curve for each knot but the last two."""
    if len(knots) < 3:
        return [x]
    width = knots[-1] - knots[0]
    cube = lambda k: F.pow(F.greatest((x - k) / width, F.lit(0.0)), 3)
    part = lambda k: (cube(k) - cube(knots[-1])) * width / (knots[-1] - k)
    return [x, *(part(k) - part(knots[-2]) for k in knots[:-2])]


class Additive:
    """Weighted logistic regression on a spline basis of numbers and all levels of factors."""

    def __init__(self, knots: dict[str, list[float]], levels: dict[str, list[str]], model: Model):
        self.knots, self.levels, self.model = knots, levels, model

    @staticmethod
    def _columns(knots, levels) -> list[Column]:
        made = [c.cast("double") for name, ks in knots.items() for c in spline_basis(F.col(name).cast("double"), ks)]
        made += [F.coalesce((F.col(name) == x).cast("double"), F.lit(0.0)) for name, xs in levels.items() for x in xs]
        return [F.coalesce(c, F.lit(0.0)) for c in made]

    @classmethod
    def prepare(cls, df: DataFrame, knots, levels) -> DataFrame:
        made = cls._columns(knots, levels)
        names = [f"b_{k}" for k in range(len(made))]
        held = df.select("*", *(c.alias(n) for c, n in zip(made, names, strict=True)))
        return assembled(held, names).drop(*names)

    @classmethod
    def fit(cls, df: DataFrame, numbers: list[str], levels: dict[str, list[str]], label: str = "label", weights: tuple[float, float] = (1.0, 5.0), n_knots: int = 4, ridge: float = 0.01) -> Additive:
        shares = [k / (n_knots - 1) for k in range(n_knots)]
        found = df.agg(*(F.percentile_approx(c, shares).alias(c) for c in numbers)).first() if numbers else {}
        knots = {c: sorted({float(v) for v in found[c] or []}) for c in numbers}
        held = cls.prepare(df.withColumn("w_", F.when(F.col(label) == 1, weights[1]).otherwise(weights[0])), knots, levels)
        return cls(knots, levels, LogisticRegression(labelCol=label, weightCol="w_", regParam=ridge, maxIter=30).fit(held))

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        made = self.model.transform(self.prepare(df, self.knots, self.levels))
        return made.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _spline_values(x: np.ndarray, knots: list[float]) -> list[np.ndarray]:
    """spline_basis() of an array."""
    if len(knots) < 3:
        return [x]
    width = knots[-1] - knots[0]
    cube = lambda k: np.maximum((x - k) / width, 0.0) ** 3
    part = lambda k: (cube(k) - cube(knots[-1])) * width / (knots[-1] - k)
    return [x, *(part(k) - part(knots[-2]) for k in knots[:-2])]


def mean_score(df: DataFrame, models: list[Additive], keep: list[str], out: str = "p") -> DataFrame:
    """(keep, out): the mean probability by models of numbers without factors, 0 without models.

    All models score a row at once; as columns, each would put its whole basis into the plan of the next.
    """
    if not models:
        return df.select(*keep, F.lit(0.0).alias(out))
    numbers = list(models[0].knots)
    parts = [(m.knots, m.model.coefficients.toArray(), m.model.intercept) for m in models]

    def run(batches):
        for batch in batches:
            null = [x.is_null().to_numpy(zero_copy_only=False) for x in batch.columns[len(keep) :]]
            values = [np.where(gone, 0.0, x.to_numpy(zero_copy_only=False)) for x, gone in zip(batch.columns[len(keep) :], null, strict=True)]
            total = np.zeros(batch.num_rows)
            for knots, weights, intercept in parts:
                basis = [np.where(gone, 0.0, v) for name, x, gone in zip(numbers, values, null, strict=True) for v in _spline_values(x, knots[name])]
                with np.errstate(over="ignore"):
                    total += 1 / (1 + np.exp(-(np.array(basis).T @ weights + intercept)))
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(total / len(parts))], names=[*keep, out])

    kinds = ", ".join(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in keep)
    return df.select(*keep, *(F.col(x).cast("double") for x in numbers)).mapInArrow(run, f"{kinds}, `{out}` double")


def pruning_rounds(df: DataFrame, numbers: list[str], levels: dict[str, list[str]], key: str, rounds: int = 50, sizes: dict[int, int] | None = None, seed: int = 0) -> tuple[list[Additive], DataFrame]:
    """Fit on a draw, score the pool, drop the easy negatives, again; the pool is written after each round."""
    pool, models = df, []
    for k in range(rounds):
        model = Additive.fit(balanced(pool, "label", key, sizes or {0: 20_000, 1: 4_000}, seed + k), numbers, levels)
        models.append(model)
        pool = durable(metrics.prune_negatives(model.score(pool)).drop("p"), "pool")
    return models, pool


def local_models(df: DataFrame, vectors: DataFrame, centres: list[tuple[int, list[float]]], numbers: list[str], key: str, k_pool: int = POOL) -> list[Additive]:
    """For each centre: its k_pool nearest remaining negatives and all positives make a model; those negatives then leave the pool."""
    from loomwright.operators.neighbors import k_nearest

    pool, models = vectors.join(df.filter("label = 0").select(F.col(key).alias("id")), "id", "left_semi"), []
    positives = df.filter("label = 1")
    for _, centre in centres:
        near = durable(k_nearest(pool, centre, k_pool).select("id"), "near")
        if near.isEmpty():
            break
        part = df.join(near.withColumnRenamed("id", key), key, "left_semi").unionByName(positives)
        models.append(Additive.fit(part, numbers, {}, weights=(1.0, 2.0)))
        pool = durable(pool.join(near, "id", "left_anti"), "pool")
    return models


def stacked(df: DataFrame, models: list[Additive], columns: list[str], key: str, prefix: str = "bam", **forest) -> tuple[Forests, DataFrame]:
    """Base models' scores become columns of a forest ensemble; the columns are kept."""
    for k, model in enumerate(models):
        df = model.score(df, f"{prefix}{k}")
    df = durable(df, "stacked")
    names = [*columns, *(f"{prefix}{k}" for k in range(len(models)))]
    return Forests.fit(df, names, key, **forest), df


def per_cluster(df: DataFrame, clusters: list[int], columns: list[str], key: str, **forest) -> DataFrame:
    """Scores by a forest of each row's own cluster; 0 where a cluster lacks a class. clusters: a bounded list of heads."""
    found = None
    for c in clusters:
        part = df.filter(F.col("cluster") == c)
        classes = part.select("label").distinct().count()
        one = Forests.fit(part, columns, key, **forest).score(part) if classes > 1 else part.withColumn("p", F.lit(0.0))
        found = one if found is None else found.unionByName(one)
    return found if found is not None else df.withColumn("p", F.lit(0.0))
