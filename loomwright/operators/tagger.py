"""A trainable backoff tagger: trigram, bigram, unigram and affix stages over a base tagger.

Each stage maps a context to its most frequent tag. It is trained on contexts that the stages under it get wrong
somewhere, with the true tags as history; so training is counting and joining. Tagging goes from left to right, because
history then is what has been tagged so far: a fold over each sentence, with all tables in every Python worker.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.session import durable

#: From the last resort to the first choice.
STAGES = ("affix", "unigram", "bigram", "trigram")
SUFFIX, STEM = 3, 2
#: Contexts of a model, which the driver and every worker hold.
MOST = 2_000_000
SPLIT = "\x1f"


def context(stage: str) -> Column:
    """The context of a row (word, back1, back2: the two tags before, null at a sentence's start); null where a stage has none."""
    word = F.col("word")
    if stage == "affix":
        return F.when(F.length(word) >= SUFFIX + STEM, F.substring(word, -SUFFIX, SUFFIX))
    before = {"unigram": [], "bigram": ["back1"], "trigram": ["back2", "back1"]}[stage]
    return F.concat_ws(SPLIT, *(F.coalesce(F.col(b), F.lit("")) for b in before), word)


def context_of(stage: str, word: str, tags: Sequence[str | None]) -> str | None:
    """The same for a word and the tags given so far."""
    if stage == "affix":
        return word[-SUFFIX:] if len(word) >= SUFFIX + STEM else None
    n = STAGES.index(stage) - 1
    history = ["", "", *(t or "" for t in tags[-2:])][-n:] if n else []
    return SPLIT.join([*history, word])


class BackoffTagger:
    """tables: stage -> {context: tag}."""

    def __init__(self, tables: dict[str, dict[str, str]]):
        self.tables = tables

    @classmethod
    def train(cls, sentences: DataFrame, base: Column | None = None, cutoff: int = 0) -> BackoffTagger:
        """sentences: (id, words array<struct<word, tag>>), a row each; base: the tag of column word by the last stage of all.

        A context's tag is its most frequent one, the first by name of equal ones, if it occurs more than cutoff times.
        Words without a tag count in nobody's favour. No sentences give empty tables.
        """
        rows = sentences.select("words", F.monotonically_increasing_id().alias("s")).select("s", F.posexplode("words").alias("at", "w")).select("s", "at", "w.word", "w.tag")
        w = Window.partitionBy("s").orderBy("at")
        rows = rows.withColumn("back1", F.lag("tag").over(w)).withColumn("back2", F.lag("tag", 2).over(w)).filter("tag is not null and word is not null")
        rows = durable(rows.withColumn("guess", base if base is not None else F.lit(None).cast("string")).drop("s", "at"), "words")
        tables = {}
        for stage in STAGES:
            keyed = rows.withColumn("context", context(stage))
            counts = keyed.filter("context is not null").groupBy("context", "tag").agg(F.count(F.lit(1)).alias("n"), F.max((~F.col("tag").eqNullSafe(F.col("guess"))).cast("int")).alias("useful"))
            best = counts.groupBy("context").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("tag"))).alias("b"), F.max("useful").alias("useful"))
            table = durable(best.filter((F.col("useful") == 1) & (-F.col("b.n") > cutoff)).select(F.col("context").alias("of"), F.col("b.tag").alias("best")), "stage")
            if (n := table.count()) > MOST:
                raise ValueError(f"{n} {stage} contexts are too many for one model; raise cutoff")
            tables[stage] = {r["of"]: r["best"] for r in table.collect()}
            rows = durable(keyed.join(table, F.col("context") == F.col("of"), "left").withColumn("guess", F.coalesce("best", "guess")).drop("context", "of", "best"), "words")
        return cls(tables)

    def tags(self, words: list[str], base: list[str | None]) -> list[str | None]:
        """The tags of a sentence's words; base: what the last stage of all says."""
        found: list[str | None] = []
        for word, otherwise in zip(words, base, strict=True):
            found.append(self.tag(word, found[-2:], otherwise))
        return found

    def tag(self, word: str, before: Sequence[str | None], otherwise: str | None) -> str | None:
        """The tag of a word by up to two tags before it."""
        return next((t for s in reversed(STAGES) if (c := context_of(s, word, before)) is not None and (t := self.tables[s].get(c))), otherwise)

    def apply(self, sentences: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """(id, words array<struct<word, tag>>) with tags anew; the tags that come in are what the last stage of all says."""

        def run(batches):
            kind = pa.list_(pa.struct([("word", pa.string()), ("tag", pa.string())]))
            for batch in batches:
                made = []
                for pairs in batch.column(1).to_pylist():
                    words = [p["word"] for p in pairs or []]
                    made.append([{"word": w, "tag": t} for w, t in zip(words, self.tags(words, [p["tag"] for p in pairs or []]), strict=True)])
                yield pa.record_batch([batch.column(0), pa.array(made, kind)], names=[id_col, "words"])

        key = sentences.schema[id_col].dataType.simpleString()
        return sentences.select(id_col, "words").mapInArrow(run, f"`{id_col}` {key}, words array<struct<word:string,tag:string>>")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(s, c, t) for s, own in self.tables.items() for c, t in own.items()], "stage string, context string, tag string").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BackoffTagger:
        tables: dict[str, dict[str, str]] = {s: {} for s in STAGES}
        for r in spark.read.parquet(path).collect():
            tables[r["stage"]][r["context"]] = r["tag"]
        return cls(tables)
