"""Hourly series: a calendar spine, cut points, the day before and after each, periods and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hourly_spine(events: DataFrame, entity: str, ts: str) -> DataFrame:
    """(entity, hour, demand): events per hour, 0 where there are none, from the first to the last hour of all entities.

    Events are counted before anything is exchanged, so that a hot entity is at most one row per hour.
    """
    counts = events.groupBy(F.col(entity).alias("entity"), F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("demand"))
    bounds = counts.agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    hours = F.explode(F.sequence(F.col("a"), F.col("b"), F.expr("interval 1 hour"))).alias("hour")
    spine = counts.select("entity").distinct().crossJoin(F.broadcast(bounds)).select("entity", hours)  # bounds is one row
    return spine.join(counts, ["entity", "hour"], "left").select("entity", "hour", F.coalesce("demand", F.lit(0)).alias("demand"))


def segments(series: DataFrame, at: Column, before: tuple[int, int] = (-23, 0), after: tuple[int, int] = (1, 24), value: str = "demand") -> DataFrame:
    """(entity, cp, cp_time, prev, next): the two stretches around each row where ``at`` holds; incomplete ones are dropped.

    cp is the row's position within its entity, from 1. The filter is applied after the windows, which need all rows.
    """
    order = Window.partitionBy("entity").orderBy("hour")
    stretch = lambda r: F.collect_list(value).over(order.rowsBetween(*r))
    held = series.select("entity", F.col("hour").alias("cp_time"), F.row_number().over(order).alias("cp"), at.alias("at"), stretch(before).alias("prev"), stretch(after).alias("next"))
    whole = lambda r: r[1] - r[0] + 1
    return held.filter(F.col("at") & (F.size("prev") == whole(before)) & (F.size("next") == whole(after))).drop("at")


def flagged(cuts: DataFrame, train: tuple[str, str], test: tuple[str, str], fmt: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """cuts with is_train and is_test: whether the cut's time is in the period, compared as text, both ends included."""
    time = F.date_format("cp_time", fmt)
    return cuts.withColumn("is_train", time.between(*train)).withColumn("is_test", time.between(*test))


def mean_profile(cuts: DataFrame, column: str = "prev") -> DataFrame:
    """(entity, pos, mean) over an entity's segments, positions from 0."""
    return cuts.select("entity", F.posexplode(column).alias("pos", "x")).groupBy("entity", "pos").agg(F.round(F.avg("x"), 6).alias("mean"))


def walk_penalty(cuts: DataFrame, column: str = "prev") -> DataFrame:
    """(entity, cp, squared, absolute): sums of first differences of a segment that starts from 0."""
    x = F.col(column)
    steps = F.transform(x, lambda v, i: (v - F.when(i > 0, F.get(x, i - 1)).otherwise(0)).cast("double"))
    total = lambda f: F.round(F.aggregate(steps, F.lit(0.0), lambda a, s: a + f(s)), 6)
    return cuts.select("entity", "cp", total(lambda s: s * s).alias("squared"), total(F.abs).alias("absolute"))
