"""Running sums over a whole table in order of a value, without bringing the table into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, by: str, sums: list[str], parts: int = 256, descending: bool = True) -> DataFrame:
    """df with run_<x> for each x of sums: the sum of x over all rows whose ``by`` comes no later in the order.

    by: a number that is different in every row. Rows are cut into at most ``parts`` ranges of it; each range is summed
    up on its own, and the ranges before it, one row each, are added.
    """
    cuts = df.agg(F.percentile_approx(by, [k / parts for k in range(1, parts)])).first()[0] or []
    bounds = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    placed = df.withColumn("range_", F.size(F.filter(bounds, lambda b: b < F.col(by))))
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    totals = placed.groupBy("range_").agg(*(F.sum(x).alias(x) for x in sums))
    earlier = Window.orderBy(order("range_")).rowsBetween(Window.unboundedPreceding, -1)  # parts rows at most
    offsets = totals.select("range_", *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"off_{x}") for x in sums))
    inside = Window.partitionBy("range_").orderBy(order(by)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.select("*", *(F.sum(x).over(inside).alias(f"in_{x}") for x in sums)).join(F.broadcast(offsets), "range_")
    return summed.select(*df.columns, *((F.col(f"in_{x}") + F.col(f"off_{x}")).alias(f"run_{x}") for x in sums))


def previous(df: DataFrame, by: str, columns: list[str], parts: int = 256, descending: bool = True) -> DataFrame:
    """df with prev_<c> for each of columns: its value in the row before in order of ``by``; null in the first row."""
    cuts = df.agg(F.percentile_approx(by, [k / parts for k in range(1, parts)])).first()[0] or []
    bounds = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    placed = df.withColumn("range_", F.size(F.filter(bounds, lambda b: b < F.col(by))))
    order, final = (F.desc, F.min_by) if descending else (F.asc, F.max_by)
    ends = placed.groupBy("range_").agg(final(F.struct(*columns), by).alias("end"))
    ends = ends.select("range_", F.lag("end").over(Window.orderBy(order("range_"))).alias("end"))  # parts rows at most
    inside = Window.partitionBy("range_").orderBy(order(by))
    held = placed.withColumn("own", F.lag(F.struct(*columns)).over(inside)).join(F.broadcast(ends), "range_").withColumn("own", F.coalesce("own", "end"))
    return held.select(*df.columns, *(F.col("own").getField(c).alias(f"prev_{c}") for c in columns))
