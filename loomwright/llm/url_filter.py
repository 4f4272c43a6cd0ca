"""URL filters by a temporal list join: dated list entries become validity intervals, captures meet those of their time.

A list is a table of events (entry, action, verdict, day): an entry, a host or one of its parent domains, is added with
a verdict ("block" or "allow") or removed. An entry's events in order give its intervals, each from an addition to the
entry's next event. A capture is held against the intervals of its host and all parent domains that are open on its
day; the most specific entry decides. Captures are reduced to their distinct (host, day) before the join, so that a
host with a third of all captures is a few hundred rows there, one for each day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
#: Hosts that are addresses have no parent domains.
ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"
ORIGIN = "2024-01-01"


def host_of(url: Column) -> Column:
    """A URL's host: lower case, without port, login and final dot, an IPv6 address in its brackets; null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    return F.when(host != "", host)


def with_host(captures: DataFrame, url_col: str = "url") -> DataFrame:
    """captures with column host, as host_of() has it."""
    return captures.withColumn("host", host_of(F.col(url_col)))


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels or more, the longest first; a host of one label, or an address, alone."""
    labels = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.split(host, r"\."))
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, n), "."))


def intervals(events: DataFrame) -> DataFrame:
    """(entry, verdict, since, until): half-open; until is null while nothing has ended it. Of one day's events the last listed action in the order remove, allow, block counts."""
    rank = F.when(F.col("action") == "remove", 0).when(F.col("verdict") == "allow", 1).otherwise(2)
    daily = events.filter("entry is not null and day is not null").groupBy(F.lower("entry").alias("entry"), "day").agg(F.max_by(F.struct("action", "verdict"), rank).alias("e"))
    ended = daily.withColumn("until", F.lead("day").over(Window.partitionBy("entry").orderBy("day")))
    return ended.filter("e.action = 'add'").select("entry", F.col("e.verdict").alias("verdict"), F.col("day").alias("since"), "until")


def filter_urls(captures: DataFrame, events: DataFrame, day_col: str = "day", url_col: str = "url") -> DataFrame:
    """captures with host, n_active (entries in force on the day), matched_entry, verdict (null without one) and blocked.

    Of the entries in force the one with most labels decides; two intervals of one entry can't overlap. A capture
    without host or day matches nothing and isn't blocked. Repeated captures stay repeated; an empty list blocks
    nothing; no captures give an empty result. Columns of captures with the added names are replaced, any others stay.
    """
    added = ["host", "n_active", "matched_entry", "verdict", "blocked"]
    own = captures.drop(*added)
    # a capture's own columns are one column, so that none of their names can clash
    held = own.select(F.struct("*").alias("row"), host_of(F.col(url_col)).alias("c_host"), F.col(day_col).alias("c_day"))
    seen = held.filter("c_host is not null and c_day is not null").select(F.col("c_host").alias("host"), F.col("c_day").alias("day")).distinct()
    tried = seen.withColumn("entry", F.explode(suffixes(F.col("host"))))
    active = tried.join(intervals(events), "entry").filter("since <= day and (until is null or day < until)")
    decided = active.groupBy(F.col("host").alias("d_host"), F.col("day").alias("d_day")).agg(
        F.count(F.lit(1)).alias("n"), F.max_by(F.struct("entry", "verdict"), F.struct(F.length("entry"), F.col("verdict"))).alias("best")
    )
    joined = held.join(decided, (F.col("c_host") == F.col("d_host")) & (F.col("c_day") == F.col("d_day")), "left")
    return joined.select(
        *(F.col("row").getField(c).alias(c) for c in own.columns),
        F.col("c_host").alias("host"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_active"),
        F.col("best.entry").alias("matched_entry"),
        F.col("best.verdict").alias("verdict"),
        F.coalesce(F.col("best.verdict") == "block", F.lit(False)).alias("blocked"),
    )


def dated_captures(pages: DataFrame) -> DataFrame:
    """pages as captures. The table has no fetch time; a day of 2024 made from page_id stands for it."""
    return pages.select("page_id", "url", F.date_add(F.lit(ORIGIN).cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("day"))


def sample_list(pages: DataFrame) -> DataFrame:
    """A list for the pages' own hosts and parent domains, dates and verdicts made from the entry's MD5.

    Each entry is added, removed after one to four months, and every second one added again; one in five allows.
    """
    hosts = with_host(pages.select("url")).filter("host is not null").select("host").distinct()
    entries = hosts.select(F.explode(suffixes(F.col("host"))).alias("entry")).distinct()
    m = F.conv(F.substring(F.md5("entry"), 1, 6), 16, 10).cast("int")
    on = lambda k: F.date_add(F.lit(ORIGIN).cast("date"), k)
    entries = entries.withColumn("m", m).withColumn("verdict", F.when(F.col("m") % 5 == 0, "allow").otherwise("block"))
    first, last, again = F.col("m") % 200, F.col("m") % 200 + 30 + F.col("m") % 97, F.col("m") % 200 + 150
    event = lambda action, k: F.struct(F.lit(action).alias("action"), on(k).alias("day"))
    events = F.when(F.col("m") % 2 == 0, F.array(event("add", first), event("remove", last), event("add", again))).otherwise(F.array(event("add", first), event("remove", last)))
    return entries.select("entry", "verdict", F.explode(events).alias("e")).select("entry", "e.action", "verdict", "e.day")


SQL = r"""
WITH held AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS day,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)), '\.$', ''), '') AS host
  FROM pages),
labels AS (
  SELECT host, CASE WHEN regexp_matches(host, '^(\[.*\]|[0-9]+(\.[0-9]+){3})$') THEN [host] ELSE string_split(host, '.') END AS parts
  FROM (SELECT DISTINCT host FROM held WHERE host IS NOT NULL) h),
tried AS (
  SELECT host, array_to_string(list_slice(parts, k, len(parts)), '.') AS entry
  FROM labels l, LATERAL (SELECT unnest(range(1, 1 + greatest(len(l.parts) - 1, 1))) AS k) s),
listed AS (
  SELECT entry, m, CASE WHEN m % 5 = 0 THEN 'allow' ELSE 'block' END AS verdict
  FROM (SELECT DISTINCT entry, CAST('0x' || substr(md5(entry), 1, 6) AS INTEGER) AS m FROM tried) e),
spans AS (
  SELECT entry, verdict, m % 200 AS since, CASE WHEN m % 2 = 0 THEN least(m % 200 + 30 + m % 97, m % 200 + 150) ELSE m % 200 + 30 + m % 97 END AS until FROM listed
  UNION ALL
  SELECT entry, verdict, m % 200 + 150, NULL FROM listed WHERE m % 2 = 0),
active AS (
  SELECT h.page_id, s.entry, s.verdict
  FROM held h JOIN tried t ON h.host = t.host JOIN spans s ON s.entry = t.entry
  WHERE DATE '2024-01-01' + CAST(s.since AS INTEGER) <= h.day AND (s.until IS NULL OR h.day < DATE '2024-01-01' + CAST(s.until AS INTEGER))),
decided AS (
  SELECT page_id, count(*) AS n_active, arg_max(entry, length(entry)) AS matched_entry, arg_max(verdict, length(entry)) AS verdict
  FROM active GROUP BY page_id)
SELECT h.page_id, h.url, CAST(h.day AS VARCHAR) AS day, h.host, coalesce(d.n_active, 0) AS n_active, d.matched_entry, d.verdict, coalesce(d.verdict = 'block', false) AS blocked
FROM held h LEFT JOIN decided d ON h.page_id = d.page_id
"""
