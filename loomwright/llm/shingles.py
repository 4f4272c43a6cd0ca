"""Word shingles of whole texts: hashes, SimHash, and all pairs of a Jaccard similarity by an exact prefix filter.

Two sets with similarity t or more share one of the first n - ceil(t n) + 1 members of each, in any order that all sets
follow; so no pair is lost. The order puts common shingles last: by the magnitudes of the counts of ``SLOTS`` hash slots
over all documents, then by hash. The order decides only what candidates cost, not which pairs are found.

No list of documents under one shingle is joined with itself at once, which would be quadratic. The document that has the
shingle earliest in its order, so the one with the fewest shingles of its own, is compared with the others and leaves the
list: in a group of copies it is nearest to what they were copied from and connects nearly all. Documents that are
connected already need no comparison, and one whose size and place fit none in the list leaves it. Lists of more than
``cap`` documents that still hold several components take ``rounds`` more such steps. What is left is joined exactly:
the documents outside the component of the earliest one with the whole list.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.components import components
from loomwright.llm.rows import sent
from loomwright.session import durable, small_batches

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WINDOW = 1 << 16
SLOTS, CHUNK = 1 << 22, 1 << 12


def digest_runs(text: str | bytes | None, width: int) -> Iterator[bytes]:
    """The XXH64 digests (8 bytes each, big-endian, seed 42) of a text's shingles, repeats included, WINDOW at a time.

    Words are what ASCII white space separates, A-Z lower-cased. Fewer words than width make one shingle, none make none.
    """
    words = (text.encode() if isinstance(text, str) else text or b"").translate(LOWER).split()
    if not words:
        return
    width = min(width, len(words))
    digest, join, n = xxhash.xxh64_digest, b" ".join, len(words) - width + 1
    for start in range(0, n, WINDOW):
        part = words[start : min(start + WINDOW, n) + width - 1]
        yield b"".join([digest(join(x), 42) for x in zip(*(part[k:] for k in range(width)), strict=False)])


def majority(runs) -> int:
    """The 64-bit SimHash of digest runs: a bit is 1 if set in over half of them; no digest: 0."""
    counts, n = np.zeros(64, np.int64), 0
    for raw in runs:
        bits = np.frombuffer(raw, np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big") if n else 0


def members(runs) -> np.ndarray:
    """The sorted different hashes of digest runs."""
    return np.unique(np.frombuffer(b"".join(runs), ">u8").astype(np.uint64))


def shingle_set(text: str | bytes | None, width: int = 5) -> np.ndarray:
    """The sorted different hashes of a text's shingles. No word: empty."""
    return members(digest_runs(text, width))


def first_members(found: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The members of a sorted set that a set of that similarity must share one of, rare ones first."""
    n = len(found)
    order = np.argsort(counts[found % np.uint64(SLOTS)], kind="stable")
    return found[order[: n - -(-n * percent // 100) + 1]] if n else found


def _texts(batch, column: str):
    return (x or b"" for x in (v.as_py() for v in batch.column(column).cast(pa.binary())))


def slot_counts(texts: DataFrame, width: int) -> np.ndarray:
    """How many documents have a shingle in each slot, as 12 times the binary logarithm of one more, 255 at most. texts: (text, ...).

    A task's counts travel as packed arrays of CHUNK slots; nothing but a byte for each slot reaches the driver.
    """

    def count(batches):
        total = np.zeros(SLOTS, np.int32)
        for batch in batches:
            for x in _texts(batch, "text"):
                np.add.at(total, (shingle_set(x, width) % np.uint64(SLOTS)).astype(np.int64), 1)
        for k, part in enumerate(total.reshape(-1, CHUNK)):
            if part.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["chunk", "n"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("chunk").to_pylist(), batch.column("n"), strict=True):
                totals[k] = totals.get(k, 0) + np.frombuffer(zlib.decompress(raw.as_py()), np.int32).astype(np.int64)
        for k, total in sorted(totals.items()):
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([np.minimum(255, np.round(12 * np.log2(1 + total))).astype(np.uint8).tobytes()], pa.binary())], names=["chunk", "n"])

    kind, counts = "chunk int, n binary", np.zeros((SLOTS // CHUNK, CHUNK), np.uint8)
    with small_batches(texts.sparkSession, 2000):
        found = texts.select("text").mapInArrow(count, kind).repartition("chunk").mapInArrow(add, kind).collect()  # SLOTS bytes at most
    for r in found:
        counts[r["chunk"]] = np.frombuffer(r["n"], np.uint8)
    return counts.ravel()


def prefixes(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, id, th, fp, sim, n, keys), written: row number, text hash, 128-bit digest of the shingle set, SimHash, size, first members."""
    counts = slot_counts(texts, width)

    def run(batches):
        for batch in batches:
            fps, sims, sizes, keys = [], [], [], []
            for x in _texts(batch, "text"):
                runs = list(digest_runs(x, width))
                found = members(runs)
                sims.append(majority(runs))
                fps.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                keys.append(first_members(found, counts, percent).view(np.int64))
            columns = [batch.column("id"), batch.column("th"), pa.array(fps, pa.binary()), pa.array(np.array(sims, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["id", "th", "fp", "sim", "n", "keys"])

    kind = texts.schema["id"].dataType.simpleString()
    found = texts.mapInArrow(run, f"id {kind}, th bigint, fp binary, sim bigint, n int, keys array<bigint>")
    with small_batches(texts.sparkSession, 2000):
        return durable(found.withColumn("node", F.monotonically_increasing_id()), "prefixes")


def verified(pairs: DataFrame, texts: DataFrame, prints: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have the similarity, written to the shared folder."""
    pairs = durable(pairs.distinct(), "candidates")
    if pairs.isEmpty():
        return pairs

    def sets(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("node"), pa.array([shingle_set(x, width).tobytes() for x in _texts(batch, "text")], pa.binary())], names=["node", "s"])

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    nodes = durable(pairs.select(F.explode(F.array("a", "b")).alias("asked")).distinct(), "nodes")
    asked = prints.join(sent(nodes), F.col("node") == F.col("asked"), "left_semi").select("node", F.col("id").alias("own"), F.col("th").alias("own_th"))
    asked = durable(asked, "asked")
    mine = texts.join(sent(asked), F.col("id").eqNullSafe(F.col("own")) & (F.col("th") == F.col("own_th"))).select("node", "text").mapInArrow(sets, "node bigint, s binary")
    with small_batches(texts.sparkSession):
        mine = durable(mine, "sets")
        if mine.count() > asked.count():  # rows repeat
            mine = durable(mine.dropDuplicates(["node"]), "sets")
    left, right = (mine.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    # a row has both sets, so few rows are held at once
    with small_batches(texts.sparkSession):
        return durable(joined.mapInArrow(check, "a bigint, b bigint"), "links")


def similar(prints: DataFrame, repeats: DataFrame, texts: DataFrame, tried: DataFrame, width: int, percent: int, cap: int, rounds: int) -> DataFrame:
    """(node, root) of the components that all pairs of the similarity connect, of nodes that aren't repeats.

    repeats (again): nodes whose set an earlier node has; tried: pairs (a, b) to be held against the similarity besides.
    """

    def fits(n, m, i, j):
        return (100 + percent) * F.least(n - i, m - j) >= percent * (n + m)

    def possible(n, i):
        """Whether some size and place within a list's bounds would fit."""
        return ((100 + percent) * (n - i) >= percent * (n + F.col("lo"))) & (100 * F.col("hi") - (100 + percent) * F.col("first") >= percent * n)

    def rooted(rows, roots):
        return rows.join(roots.select(F.col("node").alias("m"), F.col("root").alias("r")), F.col("node") == F.col("m"), "left").select(*rows.columns, F.coalesce("r", "node").alias("root"))

    def side(rows, s, *more):
        return rows.select("key", *(F.col(c).alias(f"{c}_{s}") for c in own), *more)

    own, apart = ["node", "n", "pos", "root"], F.col("root") != F.col("c.root")
    placed = prints.join(repeats, F.col("node") == F.col("again"), "left_anti").select("node", "n", F.posexplode("keys").alias("pos", "key"))
    sizes = durable(placed.groupBy("key").count().filter("count > 1").select("key"), "keys")
    lists = durable(placed.join(sizes, "key").select("key", "node", "n", "pos"), "listed")
    found, roots = None, None
    for k in range(rounds + 2):
        known = lists.withColumn("root", F.col("node")) if roots is None else durable(rooted(lists, roots), "known")
        bounds = [F.count(F.lit(1)).alias("size"), F.min("root").alias("r"), F.max("root").alias("t"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pos").alias("first")]
        mixed = durable(known.groupBy("key").agg(*bounds, F.min(F.struct("pos", "node", "n", "root")).alias("c")).filter("r < t").drop("r", "t"), "mixed")
        if k and mixed.isEmpty():
            break
        lists = durable(known.join(mixed, "key").filter(possible(F.col("n"), F.col("pos"))).select("key", *own, "size", "c"), "lists")
        stepped = F.lit(k == 0) | (F.lit(k <= rounds) & (F.col("size") > cap))
        steps, whole = lists.filter(stepped), lists.filter(~stepped)
        pairs = steps.filter(apart & fits(F.col("n"), F.col("c.n"), F.col("pos"), F.col("c.pos"))).select(F.col("node").alias("a"), F.col("c.node").alias("b"))
        if k:
            # documents outside the earliest one's component with all; two such documents come once
            both = side(whole.filter(apart), "a").join(side(whole, "b", F.col("c.root").alias("main")), "key")
            both = both.filter(fits(F.col("n_a"), F.col("n_b"), F.col("pos_a"), F.col("pos_b")) & F.expr("root_a != root_b and (root_b = main or node_a > node_b)"))
            pairs = pairs.unionByName(both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = verified(pairs if k else tried.unionByName(pairs), texts, prints, width, percent)
        found = now if found is None else found.unionByName(now)
        roots = durable(components(found), "roots")
        lists = steps.filter(F.col("node") != F.col("c.node")).select("key", "node", "n", "pos")
    return roots
