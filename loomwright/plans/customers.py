"""Customer queries: customers are users, order lines their activities, suppliers the points of interest and branches.

A customer's target date is the day of the first urgent order, "-" without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import features as U
from loomwright.operators import metrics as M
from loomwright.operators.running import running_sums
from loomwright.plans.catalog import query, table

H1, H2, NEXT = ("1998-01-01", "1998-06-30"), ("1998-07-01", "1998-12-31"), ("1999-01-01", "1999-06-30")
LEVELS = {"channel": ["F", "O", "P"], "time_cat": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "loc_cat": ["A", "N", "R"], "mc_cat": ["F", "O"]}
#: Places of the points of interest that tell most, by signed score: the five highest, the five lowest.
TELLING = 5
SLOTS = [f"{side}_{k}" for side in ("pos", "neg") for k in range(1, TELLING + 1)]
CAT_SQL = {"channel": "o_orderstatus", "time_cat": "o_orderpriority", "loc_cat": "l_returnflag", "mc_cat": "l_linestatus"}

ACTS_SQL = f"""acts AS (SELECT o_custkey AS user_id, l_suppkey AS poi_id, CAST(o_orderdate AS DATE) AS day, {', '.join(f'{v} AS {k}' for k, v in CAT_SQL.items())}, l_orderkey, l_linenumber, l_extendedprice AS amount
FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def activities(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("channel"), F.col("o_orderpriority").alias("time_cat"), "o_orderkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("poi_id"), F.col("l_returnflag").alias("loc_cat"), F.col("l_linestatus").alias("mc_cat"), F.col("l_extendedprice").alias("amount"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("o_orderkey")


USERS_SQL = f"""target AS (SELECT o_custkey, min(strftime(o_orderdate, '%Y.%m.%d')) AS t FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey),
users AS (SELECT c_custkey AS user_id, c_mktsegment AS age_cat, c_nationkey::VARCHAR AS loc_cat, c_acctbal AS loc_geo_x, coalesce(t, '-') AS target,
  coalesce(t, '-') BETWEEN '1998.01.01' AND '1998.06.31' AS tt_a, coalesce(t, '-') BETWEEN '1998.07.01' AND '1998.12.31' AS tt_b, coalesce(t, '-') BETWEEN '1999.01.01' AND '1999.06.31' AS tt_next, coalesce(t, '-') = '-' AS tt_none
  FROM customer LEFT JOIN target ON o_custkey = c_custkey)"""


def users(spark: SparkSession, sf: str) -> DataFrame:
    """Period flags compare dates as strings, so that a bound such as 06.31 is none the worse for not existing."""
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(F.min(F.date_format("o_orderdate", "yyyy.MM.dd")).alias("t"))
    held = table(spark, sf, "customer").join(urgent, F.col("c_custkey") == F.col("k"), "left").withColumn("target", F.coalesce("t", F.lit("-")))
    flag = lambda a, b, name: F.col("target").between(a, b).alias(name)
    return held.select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("age_cat"), F.col("c_nationkey").cast("string").alias("loc_cat"), F.col("c_acctbal").alias("loc_geo_x"), "target",
        flag("1998.01.01", "1998.06.31", "tt_a"), flag("1998.07.01", "1998.12.31", "tt_b"), flag("1999.01.01", "1999.06.31", "tt_next"), (F.col("target") == "-").alias("tt_none"),
    )


@query("period_flags", f"WITH {USERS_SQL} SELECT user_id, target, tt_a, tt_b, tt_next, tt_none FROM users")
def period_flags(spark: SparkSession, sf: str) -> DataFrame:
    return users(spark, sf).select("user_id", "target", "tt_a", "tt_b", "tt_next", "tt_none")


@query("target_order", f"WITH {USERS_SQL} SELECT user_id, CASE target WHEN '-' THEN 'z' ELSE target END || lpad(user_id::VARCHAR, 12, '0') AS sort_key FROM users")
def target_order(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat(F.when(F.col("target") == "-", "z").otherwise(F.col("target")), F.lpad(F.col("user_id").cast("string"), 12, "0"))
    return users(spark, sf).select("user_id", key.alias("sort_key")).orderBy("sort_key")


@query("day_numbers", "SELECT o_orderkey, date_diff('day', DATE '2014-01-01', CAST(o_orderdate AS DATE)) AS day_no, CASE WHEN o_totalprice - 200000 < 0 THEN -1.0 ELSE o_totalprice - 200000 END AS clamped, CASE lower(o_orderstatus) WHEN 'f' THEN 0 WHEN 'o' THEN 10 WHEN 'p' THEN 11 END AS code, o_orderstatus || o_orderpriority AS combined FROM orders")
def day_numbers(spark: SparkSession, sf: str) -> DataFrame:
    over = F.col("o_totalprice") - 200000
    codes = F.create_map(*(F.lit(x) for x in ("f", 0, "o", 10, "p", 11)))
    return table(spark, sf, "orders").select("o_orderkey", U.day_number(F.col("o_orderdate")).cast("long").alias("day_no"), F.when(over < 0, -1.0).otherwise(over).alias("clamped"), F.element_at(codes, F.lower("o_orderstatus")).alias("code"), F.concat("o_orderstatus", "o_orderpriority").alias("combined"))


@query("user_activity_counts", f"WITH {ACTS_SQL} SELECT user_id, count(*) AS avt_cnt FROM acts WHERE day BETWEEN '{H1[0]}' AND '{H1[1]}' GROUP BY user_id")
def user_activity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return activities(spark, sf).filter(U.in_period(F.col("day"), *H1)).groupBy("user_id").agg(F.count(F.lit(1)).alias("avt_cnt"))


def _signed_sql(windowed: bool) -> str:
    parts = []
    for flag, (a, b) in (("tt_b", H1), ("tt_next", H2)):
        when = f"day BETWEEN '{a}' AND '{b}'" if windowed else "true"
        for sign, has in (("", flag), ("-", f"NOT {flag}")):
            parts.append(f"SELECT poi_id, {sign}(count(*) / sum(count(*)) OVER ()) AS s FROM a WHERE {when} AND {has} GROUP BY poi_id")
    return f"WITH {ACTS_SQL}, {USERS_SQL}, a AS (SELECT acts.*, tt_b, tt_next FROM acts JOIN users USING (user_id)), s AS ({' UNION ALL '.join(parts)}), p AS (SELECT DISTINCT poi_id FROM a), scores AS (SELECT p.poi_id, round(coalesce(sum(s), 0), 9) AS score FROM p LEFT JOIN s ON p.poi_id = s.poi_id GROUP BY p.poi_id)"


def _signed(spark: SparkSession, sf: str, windowed: bool) -> DataFrame:
    acts = activities(spark, sf).join(users(spark, sf).select("user_id", "tt_b", "tt_next"), "user_id")
    a, b = (H1, H2) if windowed else ((None, None), (None, None))
    return U.poi_signed_scores(acts, [("tt_b", *a), ("tt_next", *b)])


TOPBOTTOM_SQL = f"{_signed_sql(True)} SELECT *, 'pos' AS side FROM (SELECT * FROM scores ORDER BY score DESC, poi_id LIMIT {TELLING}) WHERE score > 0 UNION ALL SELECT *, 'neg' AS side FROM (SELECT * FROM scores ORDER BY score, poi_id DESC LIMIT {TELLING}) WHERE score < 0"
TELL_SQL = f"SELECT poi_id, side || '_' || row_number() OVER (PARTITION BY side ORDER BY abs(score) DESC, CASE side WHEN 'pos' THEN poi_id ELSE -poi_id END) AS slot FROM ({TOPBOTTOM_SQL})"


def telling(spark: SparkSession, sf: str) -> DataFrame:
    """(poi_id, slot): the points of interest that tell most and their places; 2 * TELLING rows at most."""
    found = M.top_bottom(_signed(spark, sf, True), "poi_id", TELLING).withColumn("tie", F.when(F.col("side") == "pos", F.col("poi_id")).otherwise(-F.col("poi_id")))
    return M.numbered(found, ["side"], [F.desc(F.abs("score")), "tie"]).select("poi_id", F.concat_ws("_", "side", "rank").alias("slot"))


COUNTS_SQL = ", ".join(f"count(*) FILTER ({c} = '{x}') AS \"{U.level_name(f'a{c}_cnt', x)}\"" for c, xs in LEVELS.items() for x in xs)
POI_SQL = ", ".join(f"count(*) FILTER (slot = '{x}') AS poi_id_{x}" for x in SLOTS)
COUNT_NAMES = ["avt_cnt", *(U.level_name(f"a{c}_cnt", x) for c, xs in LEVELS.items() for x in xs)]


def _counts(spark: SparkSession, sf: str, period: tuple[str, str], pois: bool = False) -> DataFrame:
    acts = activities(spark, sf).filter(U.in_period(F.col("day"), *period))
    if pois:
        acts = acts.join(F.broadcast(telling(spark, sf)), "poi_id", "left")  # 2 * TELLING rows
    return U.activity_counts(acts, "user_id", LEVELS, SLOTS if pois else None, "slot")


@query("user_pivot_counts", f"WITH {ACTS_SQL} SELECT user_id, count(*) AS avt_cnt, {COUNTS_SQL} FROM acts WHERE day BETWEEN '{H1[0]}' AND '{H1[1]}' GROUP BY user_id")
def user_pivot_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf, H1)


def features_sql(period: tuple[str, str], name: str = "feat") -> str:
    filled = ", ".join(f'coalesce("{c}", -1) AS "{c}"' for c in COUNT_NAMES) + ", " + ", ".join(f"coalesce(poi_id_{x}, 0) AS poi_id_{x}" for x in SLOTS)
    return f"""{name} AS (SELECT u.user_id, {filled} FROM (SELECT c_custkey AS user_id FROM customer) u LEFT JOIN (SELECT user_id, count(*) AS avt_cnt, {COUNTS_SQL}, {POI_SQL} FROM (SELECT acts.*, slot FROM acts LEFT JOIN ({TELL_SQL}) USING (poi_id)) WHERE day BETWEEN '{period[0]}' AND '{period[1]}' GROUP BY user_id) f ON f.user_id = u.user_id)"""


def _features(spark: SparkSession, sf: str, period: tuple[str, str]) -> DataFrame:
    return U.user_features(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), _counts(spark, sf, period, pois=True), "user_id")


@query("user_features_left", f"WITH {ACTS_SQL}, {features_sql(H1)} SELECT * FROM feat")
def user_features_left(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf, H1)


@query("activities_semi", f"WITH {ACTS_SQL}, {USERS_SQL} SELECT poi_id, count(*) AS n FROM acts WHERE user_id IN (SELECT user_id FROM users WHERE tt_b) AND poi_id IN (SELECT poi_id FROM ({TELL_SQL})) GROUP BY poi_id")
def activities_semi(spark: SparkSession, sf: str) -> DataFrame:
    flagged = users(spark, sf).filter("tt_b").select("user_id")
    return activities(spark, sf).join(F.broadcast(telling(spark, sf)), "poi_id", "left_semi").join(flagged, "user_id", "left_semi").groupBy("poi_id").agg(F.count(F.lit(1)).alias("n"))


@query("poi_frequency", f"WITH {ACTS_SQL}, {USERS_SQL}, n AS (SELECT poi_id, count(*) AS n FROM acts WHERE user_id IN (SELECT user_id FROM users WHERE tt_b) GROUP BY poi_id) SELECT poi_id, round(n / sum(n) OVER (), 9) AS share FROM n")
def poi_frequency(spark: SparkSession, sf: str) -> DataFrame:
    flagged = users(spark, sf).filter("tt_b").select("user_id")
    return U.poi_shares(activities(spark, sf).join(flagged, "user_id", "left_semi")).withColumn("share", F.round("share", 9))


@query("poi_signed_score", _signed_sql(True) + " SELECT * FROM scores")
def poi_signed_score(spark: SparkSession, sf: str) -> DataFrame:
    return _signed(spark, sf, True)


@query("poi_signed_score_all_days", _signed_sql(False) + " SELECT * FROM scores")
def poi_signed_score_all_days(spark: SparkSession, sf: str) -> DataFrame:
    return _signed(spark, sf, False)


@query("poi_topbottom", TOPBOTTOM_SQL)
def poi_topbottom(spark: SparkSession, sf: str) -> DataFrame:
    return M.top_bottom(_signed(spark, sf, True), "poi_id", TELLING)


@query("geo_fill_left", f"WITH {ACTS_SQL} SELECT l_orderkey, l_linenumber, coalesce(s.s_acctbal, -1.0) AS geo_x, coalesce(s.s_nationkey, -1) AS geo_y FROM acts LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON s.s_suppkey = acts.poi_id")
def geo_fill_left(spark: SparkSession, sf: str) -> DataFrame:
    branches = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("poi_id"), "s_acctbal", "s_nationkey")
    return activities(spark, sf).join(branches, "poi_id", "left").select("l_orderkey", "l_linenumber", F.coalesce("s_acctbal", F.lit(-1.0)).alias("geo_x"), F.coalesce("s_nationkey", F.lit(-1)).alias("geo_y"))


PART_SQL = "CASE WHEN tt_a THEN 'a' WHEN tt_b THEN 'b' WHEN tt_none THEN 'none' ELSE 'other' END"


def _parted(spark: SparkSession, sf: str) -> DataFrame:
    part = F.when(F.col("tt_a"), "a").when(F.col("tt_b"), "b").when(F.col("tt_none"), "none").otherwise("other")
    return users(spark, sf).withColumn("part", part).join(_features(spark, sf, H1), "user_id")


@query("partition_props", f"WITH {USERS_SQL}, u AS (SELECT {PART_SQL} AS part, age_cat, loc_cat FROM users), n AS (SELECT part, count(*) AS size FROM u GROUP BY part), l AS (SELECT part, 'age_cat' AS name, age_cat AS level FROM u UNION ALL SELECT part, 'loc_cat', loc_cat FROM u) SELECT l.part, l.name, l.level, round(count(*) / any_value(n.size), 6) AS share FROM l JOIN n ON n.part = l.part GROUP BY l.part, l.name, l.level")
def partition_props(spark: SparkSession, sf: str) -> DataFrame:
    part = F.when(F.col("tt_a"), "a").when(F.col("tt_b"), "b").when(F.col("tt_none"), "none").otherwise("other")
    return U.level_shares(users(spark, sf).withColumn("part", part), "part", ["age_cat", "loc_cat"])


@query("partition_deciles", f"""WITH {ACTS_SQL}, {USERS_SQL}, {features_sql(H1)}, u AS (SELECT {PART_SQL} AS part, loc_geo_x, f.avt_cnt FROM users JOIN feat f USING (user_id)),
l AS (SELECT part, 'loc_geo_x' AS name, loc_geo_x AS v FROM u UNION ALL SELECT part, 'avt_cnt', avt_cnt FROM u)
SELECT part, name, unnest(range(11))::INTEGER AS decile, round(unnest(quantile_cont(v::DOUBLE, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])), 6) AS value FROM l GROUP BY part, name""")
def partition_deciles(spark: SparkSession, sf: str) -> DataFrame:
    return U.deciles(_parted(spark, sf), "part", ["loc_geo_x", "avt_cnt"])


@query("center_features", f"WITH {ACTS_SQL}, {features_sql(H1)} SELECT user_id, {', '.join(f'round(\"{c}\" - avg(\"{c}\") OVER (), 6) AS \"{c}\"' for c in COUNT_NAMES)} FROM feat")
def center_features(spark: SparkSession, sf: str) -> DataFrame:
    return U.centred(_features(spark, sf, H1).select("user_id", *COUNT_NAMES), COUNT_NAMES)


Z = ["avt_cnt", "achannel_cnt_F", "aloc_cat_cnt_R"]


@query("zscore_features", f"WITH {ACTS_SQL}, {features_sql(H1, 'a')}, {features_sql(H2, 'b')}, s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in Z)} FROM a) SELECT user_id, {', '.join(f'round((b.{c} - m_{c}) / nullif(s_{c}, 0), 6) AS {c}' for c in Z)} FROM b, s")
def zscore_features(spark: SparkSession, sf: str) -> DataFrame:
    train, test = (_features(spark, sf, p).select("user_id", *Z) for p in (H1, H2))
    return U.standardised(train, test, Z)


@query("halfyear_union", f"WITH {ACTS_SQL}, {USERS_SQL}, {features_sql(H1, 'a')}, {features_sql(H2, 'b')} SELECT 'H1' AS half, user_id, avt_cnt, tt_b::INTEGER AS label FROM a JOIN users USING (user_id) UNION ALL SELECT 'H2', user_id, avt_cnt, tt_next::INTEGER FROM b JOIN users USING (user_id)")
def halfyear_union(spark: SparkSession, sf: str) -> DataFrame:
    flags = users(spark, sf)
    half = lambda name, period, flag: _features(spark, sf, period).join(flags, "user_id").select(F.lit(name).alias("half"), "user_id", "avt_cnt", F.col(flag).cast("int").alias("label"))
    return half("H1", H1, "tt_b").unionByName(half("H2", H2, "tt_next"))


@query("onehot_levels", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{x}')::INTEGER AS c_mktsegment_{x}" for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def onehot_levels(spark: SparkSession, sf: str) -> DataFrame:
    return U.one_hot(table(spark, sf, "customer"), "c_custkey", {"c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]})


@query("level_counts_drift", "WITH l AS (SELECT 'o_orderstatus' AS name, o_orderstatus AS level, o_orderdate FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_orderdate FROM orders) SELECT name, level, count(*) FILTER (o_orderdate < TIMESTAMP '1998-07-01') AS n_before, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-07-01') AS n_after FROM l GROUP BY name, level")
def level_counts_drift(spark: SparkSession, sf: str) -> DataFrame:
    old = F.col("o_orderdate") < F.lit("1998-07-01").cast("timestamp")
    long = table(spark, sf, "orders").select(old.alias("old"), "o_orderstatus", "o_orderpriority").unpivot(["old"], ["o_orderstatus", "o_orderpriority"], "name", "level")
    return long.groupBy("name", "level").agg(F.count_if("old").alias("n_before"), F.count_if(~F.col("old")).alias("n_after"))


@query("smooth_or_linear", f"WITH {ACTS_SQL}, {features_sql(H1)} " + " UNION ALL ".join(f"SELECT '{c}' AS name, count(DISTINCT \"{c}\") AS n, CASE WHEN count(DISTINCT \"{c}\") < 8 THEN 'linear' ELSE 'smooth' END AS term FROM feat" for c in COUNT_NAMES))
def smooth_or_linear(spark: SparkSession, sf: str) -> DataFrame:
    n = U.unpivoted(_features(spark, sf, H1), ["user_id"], COUNT_NAMES).select("name", "value").distinct().groupBy("name").agg(F.count("value").alias("n"))
    return n.select("name", "n", F.when(F.col("n") < 8, "linear").otherwise("smooth").alias("term"))


@query("class_weights", "SELECT toxic AS label, count(*) AS n, CASE toxic WHEN 1 THEN ceil((SELECT count(*) FROM labels WHERE toxic = 0) * 1.5 / (SELECT count(*) FROM labels WHERE toxic = 1))::DOUBLE ELSE 1.0 END AS weight FROM labels GROUP BY toxic")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "labels").groupBy(F.col("toxic").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    both = n.agg(F.max(F.when(F.col("label") == 0, F.col("n"))).alias("n0"), F.max(F.when(F.col("label") == 1, F.col("n"))).alias("n1"))
    return n.crossJoin(F.broadcast(both)).select("label", "n", F.when(F.col("label") == 1, F.ceil(F.col("n0") * 1.5 / F.col("n1")).cast("double")).otherwise(1.0).alias("weight"))  # one row


PREDICTED_SQL = "pred AS (SELECT doc_id, quality AS label, least(n_chars / 5000.0::DOUBLE, 1.0) AS p, (n_chars >= 1500)::INTEGER AS predicted FROM labels JOIN documents USING (doc_id))"


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    """A score for labelled documents: their length."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    held = table(spark, sf, "labels").join(docs, "doc_id")
    return held.select("doc_id", F.col("quality").alias("label"), F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("p"), (F.col("n_chars") >= 1500).cast("int").alias("predicted"))


@query("confusion", f"WITH {PREDICTED_SQL} SELECT " + ", ".join(f"count(*) FILTER (label = {y} AND predicted = {p}) AS n{y}{p}" for y in (0, 1) for p in (0, 1)) + " FROM pred")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion(predicted(spark, sf))


@query("confusion_rates", f"WITH {PREDICTED_SQL} SELECT round(avg(1 - predicted) FILTER (label = 0), 6) AS tn_rate, round(avg(predicted) FILTER (label = 0), 6) AS fp_rate, round(avg(1 - predicted) FILTER (label = 1), 6) AS fn_rate, round(avg(predicted) FILTER (label = 1), 6) AS tp_rate, round(avg((label = predicted)::INTEGER), 6) AS accuracy, round(avg((label <> predicted)::INTEGER), 6) AS error FROM pred")
def confusion_rates(spark: SparkSession, sf: str) -> DataFrame:
    return M.confusion_rates(predicted(spark, sf))


ROC_SQL = f"""WITH {PREDICTED_SQL}, g AS (SELECT p, sum(label) AS g1, sum(1 - label) AS g0 FROM pred GROUP BY p),
r AS (SELECT p, (sum(g1) OVER () - sum(g1) OVER (ORDER BY p)) / sum(g1) OVER () AS tpr, (sum(g0) OVER () - sum(g0) OVER (ORDER BY p)) / sum(g0) OVER () AS fpr FROM g)"""


@query("roc_points", ROC_SQL + " SELECT p, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM r")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return M.roc_points(predicted(spark, sf))


@query("auc_step", ROC_SQL + ", s AS (SELECT fpr, lag(tpr) OVER (ORDER BY p DESC) AS ltpr, lag(fpr) OVER (ORDER BY p DESC) AS lfpr FROM r) SELECT round(sum(ltpr * (fpr - lfpr)), 6) AS auc_step FROM s")
def auc_step(spark: SparkSession, sf: str) -> DataFrame:
    return M.auc(predicted(spark, sf)).select("auc_step")


@query("auc_exact", f"WITH {PREDICTED_SQL} SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*), 6) AS auc_exact FROM pred a JOIN pred b ON a.label = 1 AND b.label = 0")
def auc_exact(spark: SparkSession, sf: str) -> DataFrame:
    return M.auc(predicted(spark, sf)).select("auc_exact")


@query("prediction_errors", f"WITH {PREDICTED_SQL} SELECT label, count(*) AS n, count(*) FILTER ((p >= 0.5)::INTEGER <> label) AS n_wrong, unnest(range(11))::INTEGER AS decile, round(unnest(quantile_cont(p, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])), 6) AS value FROM pred GROUP BY label")
def prediction_errors(spark: SparkSession, sf: str) -> DataFrame:
    return M.errors_by_label(predicted(spark, sf))


@query("set_algebra_ids", f"WITH {PREDICTED_SQL} SELECT doc_id FROM pred WHERE predicted = 1 EXCEPT SELECT doc_id FROM pred WHERE p > 0.5 INTERSECT SELECT doc_id FROM pred WHERE label = 1".replace("SELECT doc_id FROM pred WHERE predicted = 1 EXCEPT SELECT doc_id FROM pred WHERE p > 0.5", "(SELECT doc_id FROM pred WHERE predicted = 1 EXCEPT SELECT doc_id FROM pred WHERE p > 0.5)"))
def set_algebra_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = predicted(spark, sf)
    ids = lambda condition: p.filter(condition).select("doc_id")
    return ids("predicted = 1").subtract(ids("p > 0.5")).intersect(ids("label = 1"))


@query("negative_prune", f"WITH {PREDICTED_SQL}, b AS (SELECT greatest(min(p) FILTER (label = 1), least(0.5, quantile_cont(p, 0.05) FILTER (label = 0))) AS bound FROM pred) SELECT doc_id, label, round(p, 6) AS p FROM pred, b WHERE NOT (label = 0 AND p < bound)")
def negative_prune(spark: SparkSession, sf: str) -> DataFrame:
    return M.prune_negatives(predicted(spark, sf).select("doc_id", "label", "p")).withColumn("p", F.round("p", 6))


@query("score_combine", f"WITH {PREDICTED_SQL}, o AS (SELECT doc_id, least(octet_length(encode(text)) / 8000.0::DOUBLE, 1.0) AS p2 FROM documents) SELECT doc_id, round(p, 10) AS p_next, round(p * (1 - p2), 10) AS p_only, round(1 - (1 - p) * (1 - p2), 10) AS p_any FROM pred JOIN o USING (doc_id)")
def score_combine(spark: SparkSession, sf: str) -> DataFrame:
    other = table(spark, sf, "documents").select("doc_id", F.least(F.octet_length("text") / 8000.0, F.lit(1.0)).alias("p2"))
    joined = predicted(spark, sf).join(other, "doc_id")
    return joined.select("doc_id", F.round("p", 10).alias("p_next"), F.round(F.col("p") * (1 - F.col("p2")), 10).alias("p_only"), F.round(1 - (1 - F.col("p")) * (1 - F.col("p2")), 10).alias("p_any"))


@query("nth_match", f"WITH {USERS_SQL} SELECT user_id, target FROM (SELECT *, row_number() OVER (PARTITION BY loc_cat ORDER BY user_id) AS r FROM users WHERE NOT tt_none AND loc_geo_x > 0) WHERE r = 5")
def nth_match(spark: SparkSession, sf: str) -> DataFrame:
    found = users(spark, sf).filter("not tt_none and loc_geo_x > 0")
    return M.numbered(found, ["loc_cat"], ["user_id"], "r").filter("r = 5").select("user_id", "target")


@query("run_boundaries", f"WITH {ACTS_SQL}, d AS (SELECT user_id, day, count(*) AS n FROM acts GROUP BY user_id, day) SELECT user_id, day::VARCHAR AS day, n, coalesce(day - lag(day) OVER (PARTITION BY user_id ORDER BY day), 0) AS gap FROM d")
def run_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    days = activities(spark, sf).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("user_id").orderBy("day")))
    return days.select("user_id", F.col("day").cast("string").alias("day"), "n", F.coalesce(gap, F.lit(0)).cast("long").alias("gap"))


@query("age_levels", "SELECT coalesce(age, '-') AS level, count(*)::BIGINT AS n FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS age FROM customer) GROUP BY 1 UNION ALL SELECT '-', 0 WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING')")
def age_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of a factor with "-" among them; BUILDING stands for what is missing."""
    held = table(spark, sf, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("age"))
    return U.level_counts(held, "age")


BEFORE, AFTER = "o_orderdate < TIMESTAMP '1998-07-01'", "o_orderdate >= TIMESTAMP '1998-07-01'"
DRIFT_NUMBERS = ["o_totalprice", "o_custkey"]


def _drift_sql(side: str, when: str) -> str:
    held = f"(SELECT * FROM orders WHERE {when})"
    levels = " UNION ALL ".join(f"SELECT '{c}' AS name, 'level' AS kind, {c}::VARCHAR AS place, count(*)::DOUBLE AS {side} FROM {held} GROUP BY {c}" for c in ("o_orderstatus", "o_orderpriority"))
    numbers = " UNION ALL ".join(f"SELECT '{c}', 'decile', lpad(unnest(range(11))::VARCHAR, 2, '0'), round(unnest(quantile_cont({c}::DOUBLE, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])), 6) FROM {held}" for c in DRIFT_NUMBERS)
    return f"{levels} UNION ALL {numbers}"


@query("drift_table", f"SELECT name, kind, place, before, after FROM ({_drift_sql('before', BEFORE)}) FULL JOIN ({_drift_sql('after', AFTER)}) USING (name, kind, place)")
def drift_table(spark: SparkSession, sf: str) -> DataFrame:
    """Levels and deciles of two periods in one table."""
    orders = table(spark, sf, "orders")
    cut = F.lit("1998-07-01").cast("timestamp")
    return U.drift(orders.filter(F.col("o_orderdate") < cut), orders.filter(F.col("o_orderdate") >= cut), ["o_orderstatus", "o_orderpriority"], DRIFT_NUMBERS)


@query("activity_order", f"WITH {ACTS_SQL} SELECT l_orderkey, l_linenumber, user_id, row_number() OVER (PARTITION BY user_id ORDER BY date_diff('day', DATE '1992-01-01', day), l_orderkey, l_linenumber) AS place FROM acts")
def activity_order(spark: SparkSession, sf: str) -> DataFrame:
    """Activities in order of user and day, each with its place among its user's."""
    acts = activities(spark, sf).withColumn("day_no", U.day_number(F.col("day"), "1992-01-01"))
    return M.numbered(acts, ["user_id"], ["day_no", "l_orderkey", "l_linenumber"], "place").select("l_orderkey", "l_linenumber", "user_id", "place")


@query("user_runs", f"WITH {ACTS_SQL}, n AS (SELECT user_id, count(*) AS n FROM acts GROUP BY user_id) SELECT user_id, 1 + coalesce(sum(n) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, sum(n) OVER (ORDER BY user_id)::BIGINT AS last FROM n")
def user_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Where each user's run of rows starts and ends when activities lie in order of user."""
    n = activities(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    run = running_sums(n, "user_id", ["n"], descending=False)
    return run.select("user_id", (F.col("run_n") - F.col("n") + 1).alias("first"), F.col("run_n").alias("last"))


@query("roc_monotone", ROC_SQL + ", s AS (SELECT fpr, tpr, lag(tpr) OVER (ORDER BY p DESC) AS ltpr, lag(fpr) OVER (ORDER BY p DESC) AS lfpr FROM r) SELECT count(*) AS n, count(*) FILTER (tpr < ltpr OR fpr < lfpr) AS n_falling FROM s")
def roc_monotone(spark: SparkSession, sf: str) -> DataFrame:
    """How many steps of the curve fall; none may."""
    return M.falling_steps(predicted(spark, sf))


TERM_NUMBERS, TERM_FACTORS = ["c_acctbal", "c_nationkey"], ["c_mktsegment", "c_name"]


@query("schema_terms", " UNION ALL ".join(f"SELECT '{c}' AS name, '{kind}' AS kind, count(DISTINCT {c}) AS n, {term} AS term FROM customer" for kind, cs in (("number", TERM_NUMBERS), ("factor", TERM_FACTORS)) for c in cs for term in ([f"'s({c},bs=''re'')'"] if kind == "factor" else [f"CASE WHEN count(DISTINCT {c}) < 8 THEN '{c}' ELSE 's({c},bs=''cr'',k=4)' END"])))
def schema_terms(spark: SparkSession, sf: str) -> DataFrame:
    """What each column of customer is in a model formula, by its type and its number of values."""
    return U.terms(table(spark, sf, "customer"), "c_custkey", leave_out="^c_(address|phone|comment)$")


@query("inspection_summary", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, min({c}::VARCHAR) AS least, max({c}::VARCHAR) AS most FROM orders" for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")))
def inspection_summary(spark: SparkSession, sf: str) -> DataFrame:
    return U.inspection(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")).drop("type")
