"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, then seeded block selection.

The words of each shard (a source's documents with one residue of a seeded hash) form a stream in seeded order, cut
into blocks of equal length. The mix's blocks are dealt to the shards by the highest quotients of target / (2k + 1),
which gives integer quotas. A shard with quota q and n blocks takes every block q // n times and q % n of them once
more, in a run that starts at a seeded block; as the stream's order is seeded too, that is a random draw of documents,
nearly all of them whole. What a document gives is what its words in these blocks come to; so none gives more than its
shard's factor rounded up, and at most ``ceiling`` times its size.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import durable

SIZE = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], ceiling: float = 3.0) -> list[float]:
    """Shares of the sum of sizes by weight; none above ceiling times its size, the excess reshared by weight."""
    left, open_, out = float(sum(sizes)), {k for k, s in enumerate(sizes) if s > 0}, [0.0] * len(sizes)
    while open_:
        rate = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if rate * weights[k] > ceiling * sizes[k]}
        for k in sorted(full or open_):
            out[k] = float(ceiling * sizes[k]) if full else rate * weights[k]
        if not full:
            break
        left -= sum(out[k] for k in sorted(full))
        open_ -= full
    return out


def sainte_lague(shares: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients share / (2k + 1), ties to the earlier; no more than most allows.

    A share has a seat for each of its quotients that is at least the least quotient that wins. That one is closed in by
    bisection; the seats of all quotients surely above it are given at once, the few around it one by one. O(n log n) in
    the number of shares, whatever the number of seats.
    """
    most = most or [seats] * len(shares)
    seats = min(seats, sum(m for m, s in zip(most, shares, strict=True) if s > 0))
    if not seats:
        return [0] * len(shares)
    share, limit = np.array(shares, float), np.array(most, float)
    share[share <= 0] = 0

    def above(quotient: float) -> np.ndarray:
        return np.minimum(limit, np.floor((share / quotient + 1) / 2))

    low, high = 0.0, 2 * share.max()  # none is at least high; at low all seats are given
    while (middle := (low + high) / 2) not in (low, high):
        low, high = (low, middle) if above(middle).sum() < seats else (middle, high)
    won = [int(w) for w in above(high * (1 + 1e-12))]
    heap = [(-s / (2 * w + 1), k) for k, (s, w) in enumerate(zip(shares, won, strict=True)) if s > 0 and w < most[k]]
    heapq.heapify(heap)
    for _ in range(seats - sum(won)):
        _, k = heapq.heappop(heap)
        won[k] += 1
        if won[k] < most[k]:
            heapq.heappush(heap, (-shares[k] / (2 * won[k] + 1), k))
    return won


#: Tables of a few numbers a row are broadcast up to this many rows: 10 MB at most.
MOST_SENT = 100_000


def small(df: DataFrame, n: int) -> DataFrame:
    """df, to be broadcast if its n rows are few."""
    return F.broadcast(df) if n <= MOST_SENT else df


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(SIZE)).cast("long")


def in_shards(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """rows (id, source, size, ...) with their source's columns, h and shard."""
    joined = rows.join(small(sources, sources.count()), F.col("source").eqNullSafe(F.col("of_source")))
    return joined.withColumn("h", F.xxhash64(F.lit(seed), "id", "size")).withColumn("shard", F.pmod(F.col("h"), F.col("shards")).cast("int"))


def _deal(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, ceiling: int, block: int, shard_rows: int, max_shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(documents with what they give, sources with their number of shards)."""
    rows = durable(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "sizes")
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
    counts.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be", "surrogatepass")))
    goal = targets([r["size"] for r in counts], [weights[k % len(weights)] for k in range(len(counts))], ceiling)
    per_shard = max(shard_rows, sum(r["n"] for r in counts) // max_shards)
    shards = [1 + r["n"] // per_shard for r in counts]
    spark = docs.sparkSession
    kind = dict(rows.dtypes)["source"]
    sources = durable(spark.createDataFrame([(r["source"], r["size"], g, s) for r, g, s in zip(counts, goal, shards, strict=True)], f"of_source {kind}, source_size bigint, target double, shards int"), "sources")
    placed = in_shards(rows, sources, seed).select("id", "source", "size", "source_size", "target", "h", "shard")
    order = Window.partitionBy("source", "shard").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    streams = durable(placed.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0))), "streams")
    lengths = streams.groupBy("source", "shard").agg(F.sum("size").alias("length")).collect()
    number = {r["source"]: k for k, r in enumerate(counts)}
    lengths = sorted(((number[r["source"]], r["shard"], r["length"]) for r in lengths if r["length"]))
    factor = [g / r["size"] if r["size"] else 0.0 for g, r in zip(goal, counts, strict=True)]
    blocks = [-(-n // block) for *_, n in lengths]
    shares = [factor[k] * n / block for k, _, n in lengths]
    quotas = sainte_lague(shares, round(sum(shares)), [b * ceiling for b in blocks])
    steps = [(counts[k]["source"], s, q // b, q % b, b) for (k, s, _), q, b in zip(lengths, quotas, blocks, strict=True)]
    plan = durable(spark.createDataFrame(steps, f"of_source {kind}, of_shard int, times bigint, more bigint, blocks bigint"), "quotas")
    dealt = streams.join(small(plan, len(steps)), F.col("source").eqNullSafe(F.col("of_source")) & (F.col("shard") == F.col("of_shard")), "left")
    stop = F.col("start") + F.col("size")
    # the run of blocks taken once more starts at lead and may go on from the stream's start
    lead = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.col("blocks"))
    over = F.greatest(lead + F.col("more") - F.col("blocks"), F.lit(0))
    shared = lambda a, b: F.greatest(F.least(stop, b * block) - F.greatest(F.col("start"), a * block), F.lit(0))
    extra = shared(lead, lead + F.col("more") - over) + shared(F.lit(0), over)
    taken = F.when((F.col("size") > 0) & F.col("blocks").isNotNull(), F.col("size") * F.col("times") + extra).otherwise(F.lit(0))
    return dealt.withColumn("taken", taken.cast("long")), sources


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), ceiling: int = 3, block: int = 16, shard_rows: int = 2000, max_shards: int = 100_000, seed: int = 7) -> DataFrame:
    """One row per document: id_col, source, size, source_size, target, taken.

    Sources in code point order, null last, weigh ``weights`` in turn. taken counts words, repeats included. A null or
    empty text has size 0 and gives nothing, as does a source of such texts. Repeated rows are documents of their own;
    rows that agree in id, source and size are alike, so their order doesn't matter. The result depends on seed and
    rows only, not on partitions. Per source and shard one row of numbers reaches the driver; documents don't. A shard has
    about shard_rows documents, more where there would be over max_shards of them besides one for each source.
    """
    dealt, _ = _deal(docs, id_col, text_col, source_col, weights, ceiling, block, shard_rows, max_shards, seed)
    return dealt.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), ceiling: int = 3, block: int = 16, shard_rows: int = 2000, max_shards: int = 100_000, seed: int = 7) -> DataFrame:
    """docs as the mix takes them; columns unchanged.

    A document comes round(taken / size) times, halves up: texts stay whole, and only those at the ends of a shard's
    run of blocks are rounded at all. Documents of size 0 come once. Rows that agree in id, source and size come alike.

    Within a shard, those that come once more are a run in the stream's order, or all but a run. So the ends of the run
    say it for every row, and no text is exchanged: each row is held against the ends of its shard.
    """
    dealt, sources = _deal(docs, id_col, text_col, source_col, weights, ceiling, block, shard_rows, max_shards, seed)
    place = F.struct("h", "id", "size")
    worded = dealt.filter("size > 0").withColumn("more", F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))) > F.coalesce("times", F.lit(0)))
    ends = worded.groupBy(F.col("source").alias("e_source"), F.col("shard").alias("e_shard")).agg(
        F.max(F.coalesce("times", F.lit(0))).alias("times"), *(f(F.when(c, place)).alias(n) for n, f, c in (("a", F.min, F.col("more")), ("b", F.max, F.col("more")), ("c", F.min, ~F.col("more")), ("d", F.max, ~F.col("more"))))
    )
    ends = durable(ends, "ends")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    held = in_shards(rows, sources, seed).join(small(ends, ends.count()), F.col("source").eqNullSafe(F.col("e_source")) & (F.col("shard") == F.col("e_shard")), "left")
    around = (F.col("c") > F.col("a")) & (F.col("d") < F.col("b"))
    once_more = F.when(F.col("a").isNull(), False).when(F.coalesce(around, F.lit(False)), ~place.between(F.col("c"), F.col("d"))).otherwise(place.between(F.col("a"), F.col("b")))
    times = F.when(F.col("size") > 0, F.coalesce("times", F.lit(0)) + once_more.cast("int")).otherwise(1).cast("int")
    taken = held.select("row", times.alias("times")).filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
