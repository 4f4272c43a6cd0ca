"""Readers, reports, streams, metrics, neighbours and sparse codes on hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import features, metrics, neighbors, running, segments, sparsecode, topics
from loomwright.sources import files
from loomwright.streaming import text as streams


def test_document_tree(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, text in {"1.txt": "####a b@@@@pub one", "sub/1_bio.txt": "bio text", "2.txt": "no marker", "small.txt": "x"}.items():
        (tmp_path / "in" / name).write_text(text)
    root = str(tmp_path / "in")
    docs = files.documents(spark, root)
    assert sorted(r.doc_id for r in docs.collect()) == ["1.txt", "2.txt", "small.txt", "sub/1_bio.txt"]
    assert files.documents(spark, root, min_bytes=5).count() == 3
    assert tuple(files.size_counts(spark, root, 5).first()) == (4, 1)
    assert [tuple(r) for r in files.publications(docs).collect()] == [("1", "a b", "pub one", "bio text")]
    files.write_keyphrases(spark.createDataFrame([("d", ["a", "b c"], "s")], "doc_id string, keyphrases array<string>, key_sentence string"), f"{tmp_path}/kp")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/kp").collect()) == ["a|||b c", "s"]
    files.write_submission(spark.createDataFrame([(1, 0.5)], "user_id int, score double"), f"{tmp_path}/sub")
    assert {r.value for r in spark.read.text(f"{tmp_path}/sub").collect()} == {"#USER_ID,SCORE", "1,0.5"}  # each part has the header
    files.write_phrases(spark.createDataFrame([("w", 1, 2, 3, 4)], files.PHRASES), f"{tmp_path}/ph")
    assert tuple(files.delimited(spark, f"{tmp_path}/ph", files.PHRASES, "|", False).first()) == ("w", 1, 2, 3, 4)


def test_entity_series(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Time,Hour,Demand.x,anomaly_flag,season2,daytype1\n2015-01-01 00:00:00,0,-5,Outlier,Winter,3\n")
    r = files.entity_series(spark, f"{tmp_path}/e.csv").first().asDict()
    assert r == {"time": "2015-01-01 00:00:00", "hour": 0.0, "demand_x": -1.0, "anomaly_flag": 10.0, "season2": 0, "daytype1": 3}


def test_topic_reports(spark):
    base = "Topic: 1| cluster_index: 4| word_count: 7.5| weighted_label: Tea\n    Tea: -0.5\n    Cup: -0.75\nTopic: 2| cluster_index: 0| word_count: 3| weighted_label: Sea\n    Sea: -0.0"
    other = "Topic: 1| cluster_index: 1| cluster_weight: 9| weighted label: Tea\n    Tea: 3"
    lines = files.report_lines(spark.createDataFrame([("a", base), ("b", other)], "doc_id string, text string"))
    got = sorted((r.doc_id, r["rank"], r.pos, r.label, r.score, r.weighted_label) for r in files.topic_reports(lines).collect())
    assert got == [("a", 1, 1, "Tea", -0.5, "Tea"), ("a", 1, 2, "Cup", -0.75, "Tea"), ("a", 2, 1, "Sea", -0.0, "Sea"), ("b", 1, 1, "Tea", 3.0, "Tea")]


def test_report_order(spark):
    good = "Topic: 1| cluster_index: 4| word_count: 7.5| weighted_label: Tea\n Tea: 5\n Cup: 2\nTopic: 2| cluster_index: 0| word_count: 3| weighted_label: Sea\n Sea: 1"
    bad = "Topic: 1| cluster_index: 4| word_count: 2| weighted_label: Tea\n Tea: 1\n Cup: 2\nTopic: 2| cluster_index: 0| word_count: 3| weighted_label: Sea\n Sea: 1"
    reports = files.topic_reports(files.report_lines(spark.createDataFrame([("good", good), ("bad", bad)], "doc_id string, text string")))
    got = {(r.doc_id, r["rank"]): (r.n_labels, r.in_order) for r in files.report_order(reports).collect()}
    assert got == {("good", 1): (2, True), ("good", 2): (1, True), ("bad", 1): (2, False), ("bad", 2): (1, False)}


def test_listings_labels_and_sinks(spark, tmp_path):
    for month, name in ((1, "a"), (2, "b")):
        (tmp_path / "mail" / "year=2001" / f"month={month}").mkdir(parents=True)
        (tmp_path / "mail" / "year=2001" / f"month={month}" / f"{name}.txt").write_text(f"text {name}\nmore")
    got = {(r.text, r.year, r.month) for r in files.partitioned(spark, f"{tmp_path}/mail").collect()}
    assert got == {("text a\nmore", 2001, 1), ("text b\nmore", 2001, 2)}
    assert [r.path for r in files.listing(spark, f"{tmp_path}/mail").collect()] == ["year=2001/month=1/a.txt", "year=2001/month=2/b.txt"]
    (tmp_path / "keys").mkdir()
    (tmp_path / "keys" / "1.txt").write_text("red tea|||sea\n")
    assert [tuple(r) for r in files.label_files(spark, f"{tmp_path}/keys").collect()] == [("1.txt", ["red tea", "sea"])]
    files.write_cleaned(spark.createDataFrame([(1, "x")], "doc_id long, clean string"), f"{tmp_path}/clean")
    assert spark.read.parquet(f"{tmp_path}/clean").first().clean == "x"
    (tmp_path / "h.csv").write_text("n,v\n1,2.5\nbad,x\n")
    assert [tuple(r) for r in files.delimited(spark, f"{tmp_path}/h.csv", "n int, v double").collect()] == [(1, 2.5)]
    files.matrix_market(spark.createDataFrame([(0, 1, 4), (1, 0, 2)], "doc_no long, token_id long, n long"), 2, 2, 2, f"{tmp_path}/mm")
    assert [r.value for r in spark.read.text(f"{tmp_path}/mm/head").collect()] == ["%%MatrixMarket matrix coordinate real general", "2 2 2"]
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/mm/body").collect()) == ["1 2 4", "2 1 2"]


def test_areas(spark):
    get = lambda rows: tuple(metrics.auc(spark.createDataFrame(rows, "label int, p double")).first())
    assert get([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)]) == (0.5, 1.0)
    assert get([(0, 0.5), (1, 0.5)]) == (None, 0.5)


def test_running_sums_in_ranges(spark):
    rng = np.random.default_rng(0)
    rows = [(float(v), int(k % 3)) for k, v in enumerate(rng.permutation(500))]
    got = {r.v: r.run_n for r in running.running_sums(spark.createDataFrame(rows, "v double, n long"), "v", ["n"], parts=16).collect()}
    assert got == {v: sum(n for w, n in rows if w >= v) for v, _ in rows}


def test_dictionary_numbers_are_dense(spark):
    docs = spark.createDataFrame([(k, " ".join(chr(97 + j) * 3 for j in range(k + 1))) for k in range(20)], "doc_id long, text string")
    words = topics.dictionary(topics.bag_of_words(docs), 20).orderBy("token_id").collect()
    assert [r.token_id for r in words] == list(range(len(words)))
    assert [(-r.df, r.token) for r in words] == sorted((-r.df, r.token) for r in words)
    assert "aaa" not in {r.token for r in words}  # in every document


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(1)
    x, h = rng.integers(0, 4, (60, 3)).astype(float), rng.integers(0, 4, (17, 3)).astype(float)
    table = lambda m: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "id long, v array<double>")
    got = {r.id: (r.head, r.distance) for r in neighbors.nearest(table(x), table(h), block=5).collect()}
    d = ((x[:, None] - h[None]) ** 2).sum(2)
    assert got == {k: (int(d[k].argmin()), float(d[k].min())) for k in range(60)}
    c = x.mean(0)
    want = {i for i in range(60) if ((x - x[i]) @ (c - x[i]) >= -1e-9).all()}
    assert {r.id for r in neighbors.boundary(table(x), block=7).collect()} == want
    assert neighbors.nearest(table(x), table(h).limit(0)).count() == 0


def test_three_whole_days_give_three_cuts(spark):
    series = spark.range(100).selectExpr("'e' AS entity", "id AS hour", "id AS demand")
    cuts = segments.segments(series, F.col("hour") % 24 == 23).orderBy("cp").collect()
    assert [r.cp - 1 for r in cuts] == [23, 47, 71] and cuts[0].prev == list(range(24)) and cuts[0]["next"] == list(range(24, 48))


def test_sparse_kernels():
    rng = np.random.default_rng(2)
    e, b = sparsecode.walk_matrix(6, 2.0), rng.standard_normal((4, 9))
    f, g = b @ b.T, rng.standard_normal((6, 4))
    x = sparsecode.sylvester(e, f, g)
    assert np.abs(e @ x + x @ f - g).max() < 1e-8
    assert e[-1, -1] == 2 and e[0, 0] == 4 and e[0, 1] == -2
    assert sparsecode.soft(np.array([-3.0, 0.5, 2.0]), 1).tolist() == [-2, 0, 1]
    assert sparsecode.between(np.array([5.0, 2.5, 1.0, -4.0]), 0, 2, 1.0).tolist() == [4, 2, 1, -3]
    flat = np.ones((5, 1))
    assert np.allclose(sparsecode.shrink_walk(flat * 10, 0.0), flat * 10)


def test_fit_lowers_the_objective(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, rng.standard_normal(6).cumsum().tolist()) for k in range(40)], "id long, y array<double>")
    for penalty in ("L2", "L1"):
        coder = sparsecode.start(rows, 6, lam_b=0.1, lam_c=0.1, penalty=penalty)
        first = sparsecode.evaluate(sparsecode.encode(rows, coder), coder)["c"]
        coded, fitted = sparsecode.fit(rows, coder, k1=4, k2=0)
        assert sparsecode.evaluate(coded, fitted)["c"] < first


def test_split_is_seeded(spark):
    users = spark.range(1000).withColumnRenamed("id", "user_id")
    a, b = features.seeded_split(users, "user_id", 0.7, seed=1)
    assert a.count() + b.count() == 1000 and 600 < a.count() < 800
    assert features.seeded_split(users, "user_id", None)[1].count() == 0


def test_streams_equal_tables(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").write.parquet(f"{tmp_path}/in")
    stream = streams.clean_english(streams.document_stream(spark, f"{tmp_path}/in"))
    streams.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    want = streams.clean_english(spark.read.parquet(f"{tmp_path}/in"))
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.select("doc_id", "clean").collect())) == sorted(map(tuple, want.select("doc_id", "clean").collect()))


def test_types_and_terms_from_the_schema(spark):
    from loomwright.operators import features as U

    df = spark.createDataFrame([(1, "-", "7", 0.5, "x", True), (2, "3", " ", 1.5, None, False), (3, "4.5", "oops", 2.5, "y", None)], "id int, a_cnt string, b_code string, v double, f string, flag boolean")
    found = U.coerced(df, {"_cnt$": "double", "_code$": "int"}).orderBy("id")
    assert [tuple(r) for r in found.select("a_cnt", "b_code", "f").collect()] == [(None, 7, "x"), (3.0, None, None), (4.5, None, "y")]
    assert U.numeric_columns(df, "^id$") == ["v"] and U.numeric_columns(df) == ["id", "v"]
    assert U.formula(df, "id", few=3, leave_out="^[ab]_") == "id ~ s(f,bs='re') + s(v,bs='cr',k=4)"
    assert U.formula(df, "id", leave_out="^[abf]_?") == "id ~ v"
    levels = {r.level: r.n for r in U.level_counts(df, "f", ("-", "z")).collect()}
    assert levels == {"-": 1, "x": 1, "y": 1, "z": 0}
    seen = {r.name: (r.type, r.n, r.n_null, r.n_distinct, r.least, r.most) for r in U.inspection(df).collect()}
    assert seen["f"] == ("string", 3, 1, 2, "x", "y") and seen["flag"] == ("boolean", 3, 1, 2, "false", "true") and seen["v"] == ("double", 3, 0, 3, "0.5", "2.5")


def test_previous_rows_across_ranges(spark):
    from loomwright.operators.running import previous

    df = spark.createDataFrame([(float(k), k * k) for k in range(50)], "p double, v long").repartition(5)
    for down in (True, False):
        got = {r.p: r.prev_v for r in previous(df, "p", ["v"], parts=7, descending=down).collect()}
        assert got == {float(k): None if k == (49 if down else 0) else (k + 1) ** 2 if down else (k - 1) ** 2 for k in range(50)}


def test_falling_steps_are_seen(spark):
    from loomwright.operators import metrics as M

    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "label int, p double")
    assert tuple(M.falling_steps(rows).first()) == (3, 0)
    # a label below 0 makes the count of positives fall
    odd = spark.createDataFrame([(-1, 0.9), (1, 0.5), (0, 0.1)], "label int, p double")
    assert M.falling_steps(odd).first()["n_falling"] >= 1


def test_boundary_of_a_square(spark):
    from loomwright.operators import neighbors as N

    corners = [(0, [0.0, 0.0]), (1, [4.0, 0.0]), (2, [0.0, 4.0]), (3, [4.0, 4.0])]
    inner = [(10 + k, [1.0 + k % 3, 1.0 + k // 3]) for k in range(9) if k != 4]
    points = spark.createDataFrame(corners + inner, "id long, v array<double>")
    for probe, block in ((100, 100), (1, 2)):
        assert sorted(r.id for r in N.boundary(points, probe=probe, block=block).collect()) == [0, 1, 2, 3]
    assert [r.id for r in N.some_of(points, 3).collect()] == sorted(sorted([k for k, _ in corners + inner], key=lambda k: __import__("hashlib").md5(str(k).encode()).hexdigest())[:3])
    assert N.boundary(points.limit(0)).collect() == []
