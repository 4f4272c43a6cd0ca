"""Drawn pairs: every draw counts and every row can be drawn."""

from loomwright.operators import neighbors


def test_every_draw_gives_a_pair(spark):
    points = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(50)], "id long, v array<double>")
    found = neighbors.pair_distances(points, 2000).collect()
    assert sorted(r.draw for r in found) == list(range(1, 2001))
    assert {r.a for r in found} == {r.b for r in found} == set(range(50))
    assert all(r.distance == (r.a - r.b) ** 2 for r in found)
    assert neighbors.pair_distances(points.limit(0), 10).collect() == []


def test_numbers_have_no_gap(spark):
    points = spark.createDataFrame([(k // 2, [1.0]) for k in range(40)], "id long, v array<double>")
    rows, n = neighbors.numbered(points, per_range=7)
    assert n == 40 and sorted(r["at"] for r in rows.collect()) == list(range(40))


def test_boundary_holds_a_block_at_a_time(spark, monkeypatch):
    """Products in pieces, blocks one after the other: the plan of the result holds none of them."""
    import numpy as np

    v = np.random.default_rng(4).normal(size=(300, 3))
    points = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    towards = v.mean(axis=0) - v
    want = {k for k in range(300) if ((v - v[k]) @ towards[k]).min() >= -1e-9}
    monkeypatch.setattr(neighbors, "PAIRS", 500)
    found = neighbors.boundary(points, block=7, probe=9)
    assert {r.id for r in found.collect()} == want
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
