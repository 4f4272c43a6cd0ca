"""Phrase tables of three sections (interests, publications, biography): counts, weights, the heaviest hundred."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import cleaning as C
from loomwright.functions import nlp
from loomwright.operators import chunker

SECTIONS = ("int", "pub", "bio")
#: Partitions of phrases for each split of the turns.
PARTS = 8


def parts_for(turns: DataFrame) -> int:
    """How many partitions of phrases there are to be: their number grows with the input, so that their size doesn't."""
    return max(PARTS * turns.rdd.getNumPartitions(), int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def section_of(role: Column) -> Column:
    return F.when(role == "system", "int").when(role == "user", "pub").otherwise("bio")


def two_word_phrases(turns: DataFrame) -> DataFrame:
    """(conv_id, section, phrase): lower-case words, two by two where only a blank is between them."""
    found = F.regexp_extract_all(F.lower(C.printable(F.col("text"))), F.lit("[a-z]+(?: [a-z]+)?"), F.lit(0))
    return turns.select("conv_id", section_of(F.col("role")).alias("section"), F.explode(found).alias("phrase"))


def noun_phrases(turns: DataFrame) -> DataFrame:
    """(conv_id, section, phrase) of tagged noun phrases; biographies lose their career sentences first."""
    text = C.printable(F.col("text"))
    text = F.when(F.col("role").isin("system", "user"), text).otherwise(nlp.without_career(text))
    held = turns.select("conv_id", section_of(F.col("role")).alias("section"), text.alias("text"))
    found = chunker.each(held, C.BREAKS_TO_SENTENCES(F.col("text")), "several array<string>, single array<string>", chunker.wcd_chunks)
    return found.select("conv_id", "section", F.explode(F.concat("several", "single")).alias("phrase"))


def phrase_counts(phrases: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """(key, phrase, cint, cpub, cbio, len) of (key, section, phrase) rows.

    W: words of interests and publications. Publication phrases need a word in W; biography phrases too, if W has more
    than four words. A phrase's count in a section is the sum over its words of the word's count there, words that start
    with a number left out there; len is its number of words of three letters or more.
    """
    number = re.compile(C.STARTS_WITH_NUMBER, re.ASCII)

    def count(found: pa.Table) -> pa.Table:
        whole = found.column(key)[0].is_valid  # no null equals another, so words of a null key have no counts
        times = Counter(zip(found.column("section").to_pylist(), found.column("phrase").to_pylist(), strict=True))
        words = {p: [w for w in (re.split(r"\W", p, flags=re.ASCII) if p is not None else []) if len(w) > 2] for _, p in times}
        bags = {p: [w for w in ws if not number.search(w)] for p, ws in words.items()}
        known = {w for (s, p) in times if s != "bio" for w in bags[p]} if whole else set()
        kept = {(s, p): n for (s, p), n in times.items() if s == "int" or s == "pub" and bags[p] or s == "bio" and (len(known) <= 4 or not known.isdisjoint(bags[p]))}
        sums: dict[str, Counter] = {s: Counter() for s in SECTIONS}
        for (s, p), n in kept.items():
            for w in bags[p] if whole else ():
                sums[s][w] += n
        phrases = list(dict.fromkeys(p for _, p in kept))
        columns = {f"c{s}": pa.array([sum(sums[s][w] for w in bags[p]) for p in phrases], pa.int64()) for s in SECTIONS}
        return pa.table({key: found.column(key).combine_chunks().take(pa.array([0] * len(phrases), pa.int64())), "phrase": pa.array(phrases, pa.string()), **columns, "len": pa.array([len(words[p]) for p in phrases], pa.int32())})

    kind = phrases.schema[key].dataType.simpleString()
    dealt = phrases.select(key, "section", "phrase")
    dealt = dealt.repartition(parts, key) if parts else dealt
    return dealt.groupBy(key).applyInArrow(count, f"`{key}` {kind}, phrase string, cint bigint, cpub bigint, cbio bigint, len int")


def top_weights(counts: DataFrame, key: str, least: float = 1e-3, n: int = 100, parts: int | None = None) -> DataFrame:
    """(key, phrase, weight, rank): (8 cint + 2 cpub + cbio) / len, as shares of the key's sum, the n heaviest of at least ``least``."""
    raw = (counts.repartition(parts, key) if parts else counts).filter("len > 0").withColumn("w", (8 * F.col("cint") + 2 * F.col("cpub") + F.col("cbio")) / F.col("len"))
    share = raw.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy(key))).filter(F.round("weight", 9) >= least)
    order = Window.partitionBy(key).orderBy(F.desc(F.round("weight", 9)), "phrase")
    return share.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(key, "phrase", F.round("weight", 6).alias("weight"), "rank")
