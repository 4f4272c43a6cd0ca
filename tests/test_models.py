"""What the embedding models are given: whole vectors, centres on the boundary, the whole pool."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwright.operators import neighbors, upsell
from loomwright.plans import models
from loomwright.plans.neighbors import sides


def test_local_models_see_whole_vectors(spark, small, monkeypatch):
    seen = {}

    def local_models(df, vectors, centres, numbers, key, k_pool=upsell.POOL):
        seen.update(centres=[c for c, _ in centres], numbers=numbers, k_pool=k_pool, columns=df.columns)
        return []

    monkeypatch.setattr(upsell, "local_models", local_models)
    models.local_additive(spark, small)
    _, positives, _ = sides(spark, small)
    edge = sorted(r.id for r in neighbors.boundary(positives).collect())
    drawn = sorted(sorted(edge, key=lambda k: hashlib.md5(str(k).encode()).hexdigest())[:24])
    assert edge and seen["centres"] == drawn
    assert seen["numbers"] == [f"e{k}" for k in range(64)] and set(seen["numbers"]) <= set(seen["columns"])
    assert seen["k_pool"] == 8000


def table(spark, n=400):
    """x decides the label beyond 1 on either side; z is noise; g a factor that says nothing."""
    rng = random.Random(11)
    rows = [(k, x := rng.uniform(-2, 2), rng.random(), rng.choice("ab"), int(abs(x) > 1)) for k in range(n)]
    return spark.createDataFrame(rows, "id long, x double, z double, g string, label int"), rows


def area(scored):
    from loomwright.operators import metrics

    return metrics.auc(scored).first()["auc_exact"]


def test_draws_are_balanced_and_repeatable(spark):
    df, rows = table(spark)
    one, again = (sorted(r.id for r in upsell.balanced(df, "label", "id", {0: 50, 1: 10_000}, 3).collect()) for _ in range(2))
    positives = {r[0] for r in rows if r[4]}
    assert one == again and positives <= set(one) and 20 <= len(set(one) - positives) <= 90


def test_forests_average_their_models(spark):
    df, _ = table(spark)
    model = upsell.Forests.fit(df, ["x", "z"], "id", forests=2, trees=15, sizes={0: 300, 1: 300})
    scored = model.score(df)
    parts = [upsell.Forests([m], ["x", "z"]).score(df).select("id", F.col("p").alias(f"p{k}")) for k, m in enumerate(model.models)]
    both = scored.join(parts[0], "id").join(parts[1], "id")
    assert both.filter(F.abs(F.col("p") - (F.col("p0") + F.col("p1")) / 2) > 1e-9).count() == 0
    assert area(scored) > 0.99


def test_spline_bends_where_a_line_cannot(spark):
    df, _ = table(spark)
    bent = upsell.Additive.fit(df, ["x", "z"], {"g": ["a", "b"]}, weights=(1.0, 1.0), n_knots=6)
    straight = upsell.Additive.fit(df, ["x"], {}, weights=(1.0, 1.0), n_knots=2)
    assert area(bent.score(df)) > 0.97 > 0.65 > area(straight.score(df))


def test_spline_basis_is_natural(spark):
    knots = [0.0, 1.0, 2.0, 4.0]
    xs = [5.0, 6.0, 7.0, -1.0, -2.0, -3.0]
    got = [[r[f"b{k}"] for k in range(3)] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", *(c.alias(f"b{k}") for k, c in enumerate(upsell.spline_basis(F.col("x"), knots)))).orderBy("i").collect()]
    for k in range(3):  # straight beyond the last knot and before the first one
        assert got[2][k] - got[1][k] == pytest.approx(got[1][k] - got[0][k]) and got[5][k] - got[4][k] == pytest.approx(got[4][k] - got[3][k])


def test_pruning_keeps_all_positives(spark):
    df, rows = table(spark)
    models_made, pool = upsell.pruning_rounds(df, ["x", "z"], {}, "id", rounds=3)
    left = {r.id: r.label for r in pool.collect()}
    assert len(models_made) == 3 and {r[0] for r in rows if r[4]} <= set(left) and len(left) < len(rows)


def test_local_models_use_up_the_negatives(spark):
    df, rows = table(spark, 120)
    vectors = df.select("id", F.array("x", "z").alias("v"))
    n = sum(1 - r[4] for r in rows)
    made = upsell.local_models(df, vectors, [(k, [0.1 * k, 0.5]) for k in range(10)], ["x", "z"], "id", k_pool=n // 2 + 1)
    assert len(made) == 2


def test_stack_and_clusters(spark):
    df, _ = table(spark)
    base = [upsell.Additive.fit(df, ["x"], {}, weights=(1.0, 1.0), n_knots=6)]
    forests, held = upsell.stacked(df, base, ["z"], "id", forests=1, trees=10, sizes={0: 300, 1: 300})
    assert forests.columns == ["z", "bam0"] and area(forests.score(held)) > 0.95
    two = df.withColumn("cluster", (F.col("x") > 1).cast("long"))  # one cluster knows one class
    scored = upsell.per_cluster(two, [0, 1], ["x", "z"], "id", forests=1, trees=10, sizes={0: 300, 1: 300})
    assert scored.count() == df.count() and scored.filter("cluster = 1 and p != 0").count() == 0
    assert area(scored.filter("cluster = 0")) > 0.99


def test_keyphrase_model_against_counting(spark):
    from loomwright.operators import keyphrases

    rng = random.Random(2)
    found = [(d, f"p{k}", rng.randint(1, 5), rng.randint(0, 9) / 10) for d in range(30) for k in rng.sample(range(40), 12)]
    labels = {(d, p) for d, p, tf, at in found if tf > 3 and at < 0.4}
    df = spark.createDataFrame(found, "doc_id long, phrase string, tf long, first_position double")
    model = keyphrases.train(df, spark.createDataFrame(sorted(labels), "doc_id long, phrase string"), 30)
    seen = Counter(p for _, p, _, _ in found)
    rows = [(d, p, tf * math.log(30 / seen[p]), at) for d, p, tf, at in found]
    cut = lambda v, cuts: sum(v > c for c in cuts)
    binned = [((d, p) in labels, cut(t, model.tfidf_cuts), cut(at, model.position_cuts)) for d, p, t, at in rows]
    for c in (0, 1):
        own = [b for b in binned if b[0] == c]
        assert model.logs["class", c] == pytest.approx(math.log((len(own) + 1) / (len(binned) + 2)))
        for axis, cuts in ((1, model.tfidf_cuts), (2, model.position_cuts)):
            for b in range(len(cuts) + 1):
                assert model.logs[axis, c, b] == pytest.approx(math.log((sum(x[axis] == b for x in own) + 1) / (len(own) + len(cuts) + 1)))
    got = {r.doc_id: r.keyphrases.split("|||") for r in keyphrases.extract(model, df, 30, k=3).collect()}
    for d in range(30):
        odds = {p: sum(model.logs[a, 1, b] - model.logs[a, 0, b] for a, b in ((1, cut(t, model.tfidf_cuts)), (2, cut(at, model.position_cuts)))) for e, p, t, at in rows if e == d}
        floor = sorted(odds.values())[-3]
        assert len(got[d]) == 3 and all(odds[p] >= floor - 1e-9 for p in got[d])


def test_mean_score_is_the_mean_of_scores(spark):
    df, _ = table(spark)
    df = df.withColumn("x", F.when(F.col("id") % 9 > 0, F.col("x")))  # some are null
    fits = [upsell.Additive.fit(df.filter(F.col("id") % 3 != k), ["x", "z"], {}, n_knots=3 + k) for k in range(3)]
    want = df
    for k, model in enumerate(fits):
        want = model.score(want, f"p{k}")
    want = {r.id: (r.p0 + r.p1 + r.p2) / 3 for r in want.collect()}
    made = upsell.mean_score(df, fits, ["id", "label"])
    assert {r.id: r.p for r in made.collect()} == pytest.approx(want, abs=1e-12)
    assert "pow" not in made._jdf.queryExecution().toString().lower()  # no basis in the plan
    assert {r.p for r in upsell.mean_score(df, [], ["id"]).collect()} == {0.0}
