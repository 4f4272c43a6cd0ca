"""SimHash near-dedup: segment-popcount embedding, grid range join under Manhattan distance, exact check.

A 64-bit fingerprint is embedded as its 32 two-bit segments' popcounts (0, 1 or 2), packed into 64 bits again. A
flipped bit changes one coordinate by one, so the Manhattan distance of two embeddings never exceeds the Hamming
distance of their fingerprints. The 32 coordinates form ``BLOCKS`` blocks of four or five. Points within Manhattan
distance 2 agree in all blocks but two at most; so a grid cell is a choice of all blocks but two and their coordinates,
and each point lies in one cell for each such choice. Points that share a cell are range-joined: first the Manhattan
bound on all coordinates, then the bits. Five of seven blocks are 22 coordinates or more, of which unlike fingerprints
share all with a chance of (3/8)**22; so cells stay small up to some 10**10 fingerprints.

A cell with more than ``cell_cap`` different fingerprints isn't joined, which would be quadratic. Its fingerprints are
joined exactly by another way: each gives itself and its 64 one-bit neighbours as keys; fingerprints within two bits
share such a key, those that share one are within two bits, and no key has more than 65. Two fingerprints within two
bits either share a small cell, or are both in some large one; so no link is lost, whatever the data.

Texts of a shingle similarity of 0.8 differ in 10 bits on the average, far more than any grid can join. So near copies
by similarity (``drop_near_copies``) take the links of two bits as the first candidates, hold each against the true
similarity, and leave the pairs that bits can't show to the exact prefix filter of ``shingles``.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm import shingles
from loomwright.llm.components import components
from loomwright.llm.rows import kept_once
from loomwright.session import durable

BLOCKS = 7


def grid(blocks: int = BLOCKS) -> list[int]:
    """For each choice of all blocks but two, the mask of the packed coordinates that a cell fixes, as a signed integer."""
    cuts = [2 * (32 * k // blocks) for k in range(blocks + 1)]
    masks = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(blocks)]
    return [_signed(sum(chosen)) for chosen in combinations(masks, blocks - 2)]


def simhash(text: str | bytes | None, width: int = 3) -> int:
    """The 64-bit fingerprint: a bit is 1 if set in over half of the shingles' XXH64 (seed 42); no word: 0."""
    return shingles.majority(shingles.digest_runs(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): fp as a signed 64-bit integer. A null text counts as empty. Rows are kept as they are, repeats too."""

    def run(batches):
        for batch in batches:
            found = [simhash(x, width) for x in (v.as_py() for v in batch.column(1).cast(pa.binary()))]
            yield pa.record_batch([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def embedding(fp):
    """The 32 popcounts, packed in two bits each."""
    next_bit, odd = F.shiftrightunsigned(fp, 1), F.lit(0x5555555555555555)
    both, one = fp.bitwiseAND(next_bit).bitwiseAND(odd), fp.bitwiseXOR(next_bit).bitwiseAND(odd)
    return F.shiftleft(both, 1).bitwiseOR(one)


def manhattan(x, y):
    """Manhattan distance of two packed embeddings."""
    part = lambda v, k: F.shiftrightunsigned(v, 2 * k).bitwiseAND(F.lit(3))
    return reduce(lambda s, k: s + F.abs(part(x, k) - part(y, k)), range(1, 32), F.abs(part(x, 0) - part(y, 0)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(points: DataFrame, cell_cap: int = 32, blocks: int = BLOCKS) -> DataFrame:
    """(a, b), node numbers of points (node, fp; fp distinct) that connect all pairs within two differing bits.

    Not every pair is given: in large cells a star stands for those around one key. Each link given is a true one.
    """
    cells = F.array(*(F.struct(F.lit(k).cast("tinyint").alias("pair"), F.col("e").bitwiseAND(F.lit(mask)).alias("cell")) for k, mask in enumerate(grid(blocks))))
    placed = points.withColumn("e", embedding(F.col("fp"))).select("node", "fp", "e", F.explode(cells).alias("c")).select("node", "fp", "e", "c.pair", "c.cell")
    sizes = durable(placed.groupBy("pair", "cell").count().filter("count > 1"), "cells")
    here = lambda side: [placed["pair"] == side["pair"], placed["cell"] == side["cell"]]

    small = sizes.filter(F.col("count") <= cell_cap)
    members = durable(placed.join(small, here(small), "left_semi"), "members")
    left, right = (members.select("pair", "cell", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "fp", "e"))) for s in "ab")
    near = left.join(right, ["pair", "cell"]).filter("node_a > node_b").filter(manhattan(F.col("e_a"), F.col("e_b")) <= 2)
    near = near.filter(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= 2).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))

    large = sizes.filter(F.col("count") > cell_cap)
    crowded = durable(placed.join(large, here(large), "left_semi").select("node", "fp").distinct(), "crowded")
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(_signed(1 << k)) for k in range(64)))
    keyed = crowded.select("node", "fp", F.explode(flips).alias("flip")).select("node", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    stars = keyed.withColumn("b", F.min("node").over(Window.partitionBy("key"))).filter("node > b").select(F.col("node").alias("a"), "b")
    return near.unionByName(stars).distinct()


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, cell_cap: int = 32) -> DataFrame:
    """One row per document: id_col, fp (signed), component_id, the smallest id that links of two bits or fewer reach.

    Equal fingerprints are one node, however many documents have it. Documents without a word have fingerprint zero and
    link like any other. A null id gets the component of its fingerprint, null if no other row has it. An empty table
    gives an empty result; repeated rows stay repeated; other columns are ignored.
    """
    prints = durable(fingerprints(docs, id_col, text_col, width), "prints")
    points = durable(prints.groupBy("fp").agg(F.min("id").alias("node")).filter("node is not null"), "points")
    found = components(links(points, cell_cap))
    classes = durable(points.join(found, "node", "left").select(F.col("fp").alias("p"), F.coalesce("root", "node").alias("component_id")), "classes")
    return prints.join(classes, F.col("fp") == F.col("p"), "left").select(F.col("id").alias(id_col), "fp", "component_id")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, cap: int = 32, rounds: int = 1) -> DataFrame:
    """One row per document: id_col, th (a hash of its text), component_id, rep_th: id and text hash of the component's first document.

    Components are what pairs of ``percent`` hundredths of similarity or more connect, similarity being Jaccard's over
    the sets of width-word shingles. The first document is that with the smallest id, then text hash; null ids come
    last. Texts of fewer words than width are one shingle; those without a word are equal. Repeated rows stay repeated;
    an empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    prints = shingles.prefixes(texts, width, percent)
    equal = prints.groupBy("fp").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("fp").alias("p"), "b")
    repeats = durable(prints.join(durable(equal, "equal"), F.col("fp") == F.col("p")).filter("node > b").select(F.col("node").alias("again"), "b"), "repeats")
    # one node for each SimHash; what shares one, and what lies within two bits, is tried besides
    single = durable(prints.select("node", "sim").join(repeats, F.col("node") == F.col("again"), "left_anti"), "single")
    points = durable(single.groupBy(F.col("sim").alias("fp")).agg(F.min("node").alias("node")), "points")
    same = single.join(points.select(F.col("fp").alias("s"), F.col("node").alias("b")), F.col("sim") == F.col("s")).filter("node > b").select(F.col("node").alias("a"), "b")
    roots = shingles.similar(prints, repeats.select("again"), texts, same.unionByName(links(points)), width, percent, cap, rounds)
    based = prints.join(repeats, F.col("node") == F.col("again"), "left").select("id", "th", F.coalesce("b", "node").alias("base"))
    placed = durable(based.join(roots, F.col("base") == F.col("node"), "left").select("id", "th", F.coalesce("root", "base").alias("of")), "placed")
    first = placed.groupBy("of").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    joined = placed.join(durable(first.select("of", "first"), "first"), "of", "left")
    return joined.select(F.col("id").alias(id_col), "th", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("component_id"), F.coalesce("first.th", "th").alias("rep_th"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each component of similar_components(); columns unchanged, texts aren't exchanged while few rows go.

    That with the smallest id stays, null ids last; of rows with one id, that with the least hash of its text. Rows that
    agree in id and text are one document and come once. An empty table stays empty, extra columns stay whatever their
    names.
    """
    found = durable(similar_components(docs, id_col, text_col, **how).withColumnRenamed(id_col, "of_id"), "near")
    stays = F.col("of_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("rep_th"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return kept_once(docs, found.select("of_id", F.col("th").alias("of_key"), stays.alias("stays")), F.col(id_col), F.xxhash64(text))
