"""Readers and writers: document trees, paired files, label files, delimited tables, topic reports, matrices, submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions import cleaning as C

ANOMALIES = {"null": 0, "outlier": 10, "missing": 11, "redundant": 12, "dls_missing": 21, "dls_redundant": 22}
SEASONS = {"winter": 0, "spring": 1, "summer": 2, "autumn": 3}
CATEGORICAL = ("daytype", "specialday", "season")
RAW = ("time",)

BANK = "poi_id int, geo_x double, geo_y double"
ACTIVITIES = "user_id int, poi_id int, date string, channel string, time_cat string, loc_cat string, mc_cat string, card_cat string, amt_cat string, geo_x string, geo_y string"
PHRASES = "word string, cint int, cpub int, cbio int, len int"


def _relative(path: Column, root: str) -> Column:
    tail = F.regexp_replace(path, r"^[a-z]+:/+", "/")
    clean = "/" + root.split("://")[-1].strip("/") + "/"
    return F.when(F.contains(tail, F.lit(clean)), F.substring_index(tail, clean, -1)).otherwise(tail)


def documents(spark: SparkSession, root: str, recursive: bool = True, min_bytes: int = 0, glob: str | None = None) -> DataFrame:
    """(doc_id, length, text): one row per file, named by its path below root. Files under min_bytes are not read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        read = read.option("pathGlobFilter", glob)
    files = read.load(root).filter(F.col("length") >= min_bytes)
    return files.select(_relative(F.col("path"), root).alias("doc_id"), "length", F.decode(F.col("content"), "ISO-8859-1").alias("raw"), "content").select("doc_id", "length", F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.col("raw")).alias("text"))


def size_counts(spark: SparkSession, root: str, min_bytes: int = 1000) -> DataFrame:
    """One row: n_files, n_small; from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("length")
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("length") < min_bytes).alias("n_small"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path): files below root, sorted."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(_relative(F.col("path"), root).alias("path")).orderBy("path")


def partitioned(spark: SparkSession, root: str) -> DataFrame:
    """Text below year=/month= folders, with both as columns."""
    return spark.read.text(root, wholetext=True).withColumnRenamed("value", "text")


def publications(docs: DataFrame) -> DataFrame:
    """(doc_id, interests, publications, biography) of N.txt files and their N_bio.txt, which may be missing.

    Documents without a section marker give no row.
    """
    is_bio = F.col("doc_id").rlike(r"_bio\.[A-Za-z0-9]+$")
    stem = C.stem_of(F.col("doc_id"))
    main = docs.filter(~is_bio).select(stem.alias("doc_id"), C.sections(F.col("text")).alias("s"))
    bios = docs.filter(is_bio).select(stem.alias("doc_id"), F.col("text").alias("biography"))
    held = main.filter("s.interests is not null or s.publications is not null").join(bios, "doc_id", "left")
    return held.select("doc_id", F.coalesce("s.interests", F.lit("")).alias("interests"), F.coalesce("s.publications", F.lit("")).alias("publications"), F.coalesce("biography", F.lit("")).alias("biography"))


def split_labels(text: Column) -> Column:
    """array<string> of a ||| line."""
    return F.split(F.regexp_replace(text, r"[\r\n]+", ""), r"\|\|\|")


def label_files(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, keyphrases)."""
    return documents(spark, root).select("doc_id", split_labels(F.col("text")).alias("keyphrases"))


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A delimited file of a declared schema; rows that don't fit are dropped."""
    return spark.read.schema(schema).csv(path, header=header, sep=sep, mode="DROPMALFORMED")


def entity_series(spark: SparkSession, path: str) -> DataFrame:
    """An hourly series with typed columns by name: categories as bytes, ``time`` as it is, all others as numbers, negatives -1.

    Names are lower-cased, dots become underscores; anomaly_flag and season2 are mapped to their codes.
    """
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*(C.normal_name(c.replace("-", "\0")).replace("\0", "-") for c in raw.columns))

    def typed(name: str) -> Column:
        col = F.col(f"`{name}`")
        for special, codes in (("anomaly_flag", ANOMALIES), ("season2", SEASONS)):
            if name == special:
                col = F.element_at(F.create_map(*(F.lit(x) for pair in codes.items() for x in pair)), F.lower(col))
        if any(k in name for k in CATEGORICAL):
            return col.cast(T.ByteType()).alias(name)
        if name in RAW:
            return col.alias(name)
        value = col.cast("double")
        return F.when(value < 0, -1.0).otherwise(value).alias(name)

    return raw.select(*(typed(c) for c in raw.columns))


def topic_reports(lines: DataFrame) -> DataFrame:
    """(doc_id, rank, cluster_index, weight, weighted_label, label, score, pos) of report lines (doc_id, line_no, value).

    A header starts a topic, the lines below are its labels. Both header forms are read: word_count and cluster_weight.
    """
    head = r"^Topic:\s*(\d+)\s*\|\s*cluster_index:\s*(\d+)\s*\|\s*(?:word_count|cluster_weight):\s*([-\d.eE]+)\s*\|\s*weighted[_ ]label:\s*(.*?)\s*$"
    is_head = F.col("value").rlike(head)
    order = Window.partitionBy("doc_id").orderBy("line_no")
    held = lines.withColumn("head", is_head).withColumn("topic", F.sum(is_head.cast("int")).over(order))
    part = lambda k: F.regexp_extract("value", head, k)
    heads = held.filter("head").select("doc_id", "topic", part(1).cast("int").alias("rank"), part(2).cast("int").alias("cluster_index"), part(3).cast("double").alias("weight"), part(4).alias("weighted_label"))
    label = r"^\s*(.*?)\s*:\s*(-?[\d.eE+-]+)\s*$"
    labels = held.filter(~F.col("head") & F.col("value").rlike(label) & (F.col("topic") > 0)).select(
        "doc_id", "topic", F.regexp_extract("value", label, 1).alias("label"), F.regexp_extract("value", label, 2).cast("double").alias("score"), F.row_number().over(Window.partitionBy("doc_id", "topic").orderBy("line_no")).alias("pos")
    )
    return heads.join(labels, ["doc_id", "topic"], "left").drop("topic")


def report_order(reports: DataFrame) -> DataFrame:
    """(doc_id, rank, n_labels, in_order) of topic_reports(): whether a topic weighs no more than the one before, its labels'
    scores fall, and its first label is its own."""
    topics = reports.groupBy("doc_id", "rank").agg(
        F.first("weight").alias("weight"), F.first("weighted_label").alias("own"), F.count("label").alias("n_labels"), F.min_by("label", "pos").alias("top"), F.array_sort(F.collect_list(F.struct("pos", "score")))["score"].alias("scores")
    )
    before = F.lag("weight").over(Window.partitionBy("doc_id").orderBy("rank"))
    falls = F.col("scores") == F.sort_array("scores", asc=False)
    return topics.select("doc_id", "rank", "n_labels", (F.coalesce(before >= F.col("weight"), F.lit(True)) & falls & ((F.col("n_labels") == 0) | (F.col("top") == F.col("own")))).alias("in_order"))


def report_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, value) of documents (doc_id, text)."""
    return docs.select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "value")).filter(F.trim("value") != "")


def write_cleaned(df: DataFrame, path: str) -> None:
    """Cleaned documents as one table keyed by doc_id, instead of a tree of small files."""
    df.write.mode("overwrite").parquet(path)


def write_keyphrases(df: DataFrame, path: str) -> None:
    """(doc_id, keyphrases array or text, key_sentence): two lines of text for each document, in folders by doc_id."""
    phrases = F.array_join("keyphrases", "|||") if isinstance(df.schema["keyphrases"].dataType, T.ArrayType) else F.col("keyphrases")
    df.select("doc_id", F.concat_ws("\n", phrases, F.coalesce("key_sentence", F.lit(""))).alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_phrases(df: DataFrame, path: str) -> None:
    """word|cint|cpub|cbio|len without a header."""
    df.write.mode("overwrite").csv(path, sep="|", header=False)


def write_submission(df: DataFrame, path: str, user: str = "user_id", score: str = "score") -> None:
    """#USER_ID,SCORE, unquoted."""
    df.select(F.col(user).alias("#USER_ID"), F.col(score).alias("SCORE")).write.mode("overwrite").option("comment", "!").csv(path, header=True)


def matrix_market(bags: DataFrame, n_docs: int, n_tokens: int, n_values: int, path: str) -> None:
    """(doc_no, token_id, n) as coordinate text; part 0 is the head, and entries count from 1."""
    head = bags.sparkSession.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general"), (1, f"{n_docs} {n_tokens} {n_values}")], "k int, value string").coalesce(1).orderBy("k").select("value")
    body = bags.select(F.concat_ws(" ", (F.col("doc_no") + 1).cast("string"), (F.col("token_id") + 1).cast("string"), F.col("n").cast("string")).alias("value"))
    head.write.mode("overwrite").text(f"{path}/head")
    body.write.mode("overwrite").text(f"{path}/body")
