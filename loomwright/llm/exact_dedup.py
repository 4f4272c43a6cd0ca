"""Exact dedup by a tree merge of sorted digest runs, in DataFrame operations only.

Each input partition makes one run: a row per distinct text, with its largest (or smallest) identifier and count. Runs
have numbers of as many bits as there are rounds. In round k, runs whose numbers differ in bit k exchange rows: each
keeps the digests whose own bit k is its own, and gives the others away. So every row's run number takes over one bit of
its digest per round, and after the last round run r holds, merged, all digests with the bits r: a binomial exchange. The two runs that meet lie sorted by digest, and a sort aggregation walks through them in that order.

A text that fills a third of the table is one row per run from the start, and two rows per merge. Rounds add up, so
no more than ``most_runs`` runs are made; input partitions of one number are merged in the first round, many at once.

Texts count as equal if SHA-256, length and a second 64-bit hash agree; the three are the merge key, so that every
level verifies the identity it merges under.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.rows import kept_once
from loomwright.session import durable

KEY = ["digest", "n_bytes", "check"]
#: Rounds after which a table ends the lineage.
CUT = 4


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (32 bytes), n_bytes, check, run: one row per document; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("check"),
        F.spark_partition_id().alias("run"),
    )


def merged(runs: DataFrame, keep: str) -> DataFrame:
    """Rows (run, KEY, keep_id, group_size) of one run and key as one.

    The identifier goes through the aggregation as a struct, which no hash aggregation holds: so Spark sorts each run and
    merges in order of the key, within the partitions that the exchange by run has made.
    """
    best = F.max if keep == "max" else F.min
    none = F.col("keep_id").isNotNull() if keep == "max" else F.col("keep_id").isNull()
    return runs.groupBy("run", *KEY).agg(best(F.struct(none.alias("rank"), F.col("keep_id").alias("id"))).alias("kept"), F.sum("group_size").alias("group_size")).select("run", *KEY, F.col("kept.id").alias("keep_id"), "group_size")


def tree_merge(runs: DataFrame, n_runs: int, keep: str = "max", most_runs: int = 4096) -> DataFrame:
    """Merge (id, KEY, run) rows to KEY, keep_id, group_size in binomial rounds."""
    rounds = max(1, (min(n_runs, most_runs) - 1).bit_length())
    now = runs.select(F.pmod(F.col("run"), F.lit(1 << rounds)).alias("run"), *KEY, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    head = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    for k in range(rounds):
        bit = F.lit(1 << k)
        now = now.withColumn("run", F.col("run").bitwiseAND(F.bitwise_not(bit)).bitwiseOR(head.bitwiseAND(bit)))
        now = merged(now.repartition("run"), keep)
        if (k + 1) % CUT == 0 and k + 1 < rounds:
            now = durable(now, "runs")
    return now.drop("run")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", most_runs: int = 4096) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256 (lowercase hex of the UTF-8 bytes).

    The row with the largest id of each group of equal texts stays (smallest with keep="min"). Null and empty texts are
    one group. A null id never stays while its group has another one; a group of null ids only keeps them all. Rows
    that repeat both id and text are all marked kept if their id is: they're the same document. An empty table gives an
    empty result; other columns of docs are ignored.
    """
    rows = durable(digests(docs, id_col, text_col), "digests")
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    groups = durable(tree_merge(rows, n_runs, keep, most_runs).filter("group_size > 1"), "groups")
    joined = rows.join(groups.withColumnRenamed("digest", "g_digest"), (F.col("digest") == F.col("g_digest")) & (rows["n_bytes"] == groups["n_bytes"]) & (rows["check"] == groups["check"]), "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )




def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """docs without the copies, one row per distinct text; columns unchanged. Only identifiers move, not texts, while few rows go.

    Rows that stay and agree in id and text come once; nulls and empty tables are as exact_groups() has them.
    """
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    found = durable(exact_groups(docs, id_col, text_col, keep=keep).select(F.col(id_col).alias("of_id"), F.col("text_sha256").alias("of_key"), F.col("kept").alias("stays")), "kept")
    return kept_once(docs, found, F.col(id_col), sha)
