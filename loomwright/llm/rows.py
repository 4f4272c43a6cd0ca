"""Filtering whole rows by decisions made on identifiers and text hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.session import durable


#: Rows of identifiers that are sent to all executors; more are exchanged.
MOST_SENT = 500_000


def sent(found: DataFrame) -> DataFrame:
    """found, a written table of identifiers, sent to all executors in joins while it has few rows, so that the other side stays where it is."""
    return F.broadcast(found) if found.count() <= MOST_SENT else found


def kept_once(docs: DataFrame, found: DataFrame, id_: Column, key: Column) -> DataFrame:
    """docs without the rows that found, written rows of (of_id, of_key, stays), says don't stay; rows of one (id, key) come once.

    key is a hash of the text that id_ belongs to. Whole rows are one column, so that none of their names can clash. Only
    identifiers are joined; a row's texts move only if rows of its own id and text repeat, or if many rows go.
    """
    same = [F.col("own_id").eqNullSafe(F.col("of_id")), F.col("own_key") == F.col("of_key")]
    left = docs.select(F.struct("*").alias("row"), id_.alias("own_id"), key.alias("own_key"))
    gone = durable(found.filter(~F.col("stays")).select("of_id", "of_key").distinct(), "gone")
    again = durable(found.filter("stays").groupBy("of_id", "of_key").count().filter("count > 1").select("of_id", "of_key"), "again")
    left = left.join(sent(gone), same, "left_anti")
    if not again.isEmpty():
        once = left.join(again, same, "left_semi").dropDuplicates(["own_id", "own_key"])
        left = left.join(again, same, "left_anti").unionByName(once)
    return left.select("row.*")
