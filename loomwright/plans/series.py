"""Series queries: event types are entities, events per hour their demand; days end at hour 23."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import segments as S
from loomwright.plans.catalog import query, table

TRAIN, TEST = ("2024-01-01 00:00:00", "2024-01-20 23:59:59"), ("2024-01-21 00:00:00", "2024-01-31 23:59:59")

SPINE_SQL = """counts AS (SELECT event_type AS entity, date_trunc('hour', ts) AS hour, count(*) AS demand FROM events GROUP BY 1, 2),
hours AS (SELECT unnest(generate_series((SELECT min(hour) FROM counts), (SELECT max(hour) FROM counts), INTERVAL 1 HOUR)) AS hour),
spine AS (SELECT e.entity, h.hour, coalesce(c.demand, 0) AS demand FROM (SELECT DISTINCT entity FROM counts) e CROSS JOIN hours h LEFT JOIN counts c ON c.entity = e.entity AND c.hour = h.hour)"""
CUTS_SQL = (
    SPINE_SQL
    + """, w AS (SELECT entity, hour AS cp_time, row_number() OVER o AS cp, list(demand) OVER (PARTITION BY entity ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS prev,
list(demand) OVER (PARTITION BY entity ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS next FROM spine WINDOW o AS (PARTITION BY entity ORDER BY hour)),
cuts AS (SELECT * FROM w WHERE hour(cp_time) = 23 AND len(prev) = 24 AND len(next) = 24)"""
)


def spine(spark: SparkSession, sf: str) -> DataFrame:
    return S.hourly_spine(table(spark, sf, "events"), "event_type", "ts")


def cuts(spark: SparkSession, sf: str) -> DataFrame:
    return S.segments(spine(spark, sf), F.hour("hour") == 23)


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("hourly_spine", f"WITH {SPINE_SQL} SELECT entity, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, demand FROM spine")
def hourly_spine(spark: SparkSession, sf: str) -> DataFrame:
    return spine(spark, sf).select("entity", stamp("hour").alias("hour"), "demand")


@query("daily_segments", f"WITH {CUTS_SQL} SELECT entity, cp, strftime(cp_time, '%Y-%m-%d %H:%M:%S') AS cp_time, array_to_string(prev, ',') AS prev, array_to_string(next, ',') AS next FROM cuts")
def daily_segments(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return cuts(spark, sf).select("entity", "cp", stamp("cp_time").alias("cp_time"), text("prev"), text("next"))


@query("segment_flags", f"WITH {CUTS_SQL}, s AS (SELECT *, strftime(cp_time, '%Y-%m-%d %H:%M:%S') AS t FROM cuts) SELECT entity, cp, t BETWEEN '{TRAIN[0]}' AND '{TRAIN[1]}' AS is_train, t BETWEEN '{TEST[0]}' AND '{TEST[1]}' AS is_test FROM s")
def segment_flags(spark: SparkSession, sf: str) -> DataFrame:
    return S.flagged(cuts(spark, sf), TRAIN, TEST).select("entity", "cp", "is_train", "is_test")


@query("mean_profile", f"WITH {CUTS_SQL}, x AS (SELECT entity, unnest(range(24))::INTEGER AS pos, unnest(prev) AS v FROM cuts) SELECT entity, pos, round(avg(v), 6) AS mean FROM x GROUP BY entity, pos")
def mean_profile(spark: SparkSession, sf: str) -> DataFrame:
    return S.mean_profile(cuts(spark, sf))


@query("rw_penalty", f"WITH {CUTS_SQL}, x AS (SELECT entity, cp, unnest(range(24)) AS pos, unnest(prev) AS v FROM cuts), d AS (SELECT entity, cp, v - lag(v, 1, 0) OVER (PARTITION BY entity, cp ORDER BY pos) AS s FROM x) SELECT entity, cp, sum(s * s)::DOUBLE AS squared, sum(abs(s))::DOUBLE AS absolute FROM d GROUP BY entity, cp")
def rw_penalty(spark: SparkSession, sf: str) -> DataFrame:
    return S.walk_penalty(cuts(spark, sf))


@query("period_bounds", "SELECT event_type AS entity, strftime(min(ts) - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS start, least(strftime(max(ts), '%Y-%m-%d %H:%M:%S'), '2024-01-25 00:00:00') AS stop FROM events GROUP BY event_type")
def period_bounds(spark: SparkSession, sf: str) -> DataFrame:
    start = F.date_format(F.min("ts") - F.expr("interval 1 hour"), "yyyy-MM-dd HH:mm:ss")
    stop = F.least(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss"), F.lit("2024-01-25 00:00:00"))
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("entity")).agg(start.alias("start"), stop.alias("stop"))


@query("entity_listing", "SELECT DISTINCT event_type AS entity FROM events ORDER BY entity")
def entity_listing(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("entity")).distinct().orderBy("entity")
