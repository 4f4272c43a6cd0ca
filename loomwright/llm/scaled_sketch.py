"""Document fingerprints: a threshold-scaled sketch, in DataFrame operations only.

A sketch keeps every five-word shingle hash below a fixed fraction of the hash range (and the least hash where none is
below). Two sketches merge by union, and the share of the smaller one's hashes that the other has estimates how far one
document is contained in the other, however unequal they are.

To set each document beside the next one, rows go to buckets of neighbouring identifiers; the first row of a bucket is
sent to the bucket before it too. So whole texts are exchanged once, and no task sorts more than a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import durable

WIDTH = 5
#: One hash in 2**BITS is kept.
BITS = 4
#: Hexadecimal digits of a hash that its printed form has.
DIGITS = 12
#: Buckets are at most MOST: their heads are a bounded table.
MOST = 65_536


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """array<bigint>: a hash of each run of ``width`` lower-cased words; fewer words make one run, none an empty array."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    whole = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))

    def runs(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda k: F.xxhash64(*(F.get(h, k + j) for j in range(width))))

    # a one-element array passes the word hashes on, so that they're made once
    return F.flatten(F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= width, runs(h)).otherwise(whole)))


def sketch(text: Column, bits: int = BITS, width: int = WIDTH) -> Column:
    """The ascending distinct hashes of text that are below 2**-bits of the unsigned range; the least one if none is."""

    def cut(all_hashes: Column) -> Column:
        kept = F.filter(all_hashes, lambda h: F.shiftrightunsigned(h, 64 - bits) == 0)
        sign = F.lit(-(2**63))  # with the sign turned, the order of signed numbers is that of unsigned ones
        least = F.array_min(F.transform(all_hashes, lambda h: h.bitwiseXOR(sign))).bitwiseXOR(sign)
        return F.when((F.size(kept) > 0) | (F.size(all_hashes) == 0), F.array_sort(F.array_distinct(kept))).otherwise(F.array(least))

    return F.flatten(F.transform(F.array(shingle_hashes(text, width)), cut))


def likeness(a: Column, b: Column) -> Column:
    """Estimated containment of the smaller document in the other; 1 for two empty sketches, 0 for one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise((F.size(a) == F.size(b)).cast("double"))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two documents taken together; a least hash kept for want of others gives way to those below the fraction."""
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda h: F.shiftrightunsigned(h, 64 - BITS) == 0)
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def text_of(values: Column) -> Column:
    """The last DIGITS hexadecimal digits of each hash, in the order of the hashes."""
    return F.array_join(F.transform(values, lambda h: F.lower(F.right(F.lpad(F.hex(h), 16, "0"), F.lit(DIGITS)))), "")


def beside_next(docs: DataFrame, id_col: str, text_col: str, bucket_rows: int = 500) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch): each document with that of the next larger id, the last with the first.

    Null ids come last; rows of one id stand in the order of a hash of their text. Null texts count as empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.col(id_col).isNull()
    keys = docs.select(F.col(id_col).cast("bigint").alias("key"))
    n, known = keys.agg(F.count(F.lit(1)), F.count("key")).first()
    # rows without an id stand in the order of their texts' hashes, which is what their buckets are cut by
    tie = F.when(none, F.xxhash64(text)) if n > known else F.lit(None).cast("bigint")
    coarse = max(1, min(256, known // bucket_rows))
    fine = max(1, min(MOST // 256, known // (coarse * bucket_rows)))
    loose = max(1, min(MOST, (n - known) // bucket_rows))

    def cuts_of(parts: int) -> Column:
        """The key's quantiles that cut it into so many parts; 255 at most."""
        return F.percentile_approx("key", [k / parts for k in range(1, parts)]) if parts > 1 else F.array().cast("array<bigint>")

    def passed(cuts: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c <= F.col("key")))

    wide = F.array(*(F.lit(x).cast("bigint") for x in keys.agg(cuts_of(coarse)).first()[0] or []))
    at = F.coalesce(passed(wide), F.lit(0)).alias("at") if coarse > 1 else F.lit(0).alias("at")
    # each wide part is cut by its own quantiles: 256 rows of 255 numbers at most, however the identifiers cluster
    narrow = durable(keys.filter("key is not null").select("key", at).groupBy("at").agg(cuts_of(fine).alias("cuts")), "cuts").withColumnRenamed("at", "of")

    def placed(df: DataFrame) -> DataFrame:
        found = df.withColumn("at", at).join(F.broadcast(narrow), F.col("at") == F.col("of"), "left")
        share = F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * loose).cast("int")
        own = F.col("at") * fine + F.greatest(F.coalesce(passed(F.col("cuts")), F.lit(0)), F.lit(0))
        return found.withColumn("bucket", F.when(F.col("none"), coarse * fine + F.least(share, F.lit(loose - 1))).otherwise(own).cast("int")).drop("at", "of", "cuts")

    # a row per bucket: MOST at the most, so one window over all and a broadcast are bounded
    order = Window.orderBy("bucket")
    keyed = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("bigint").alias("key"), none.alias("none"), tie.alias("tie"), text.alias("text"))
    heads = placed(keyed.drop("id", "text")).groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("head"))
    heads = heads.select("head", F.lag("bucket").over(order).alias("before"), F.max("bucket").over(Window.partitionBy()).alias("final"))
    heads = heads.select("head", F.coalesce("before", "final").alias("to"), F.col("before").isNull().cast("int").alias("wrap"))

    rows = placed(keyed).withColumn("sketch", sketch(F.col("text")))
    rows = rows.join(F.broadcast(heads), F.col("key").eqNullSafe(F.col("head.key")) & F.col("tie").eqNullSafe(F.col("head.tie")), "left")
    own = F.struct(F.col("bucket"), F.lit(0).alias("wrap"), F.lit(0).alias("ghost"))
    sent = F.struct(F.col("to").alias("bucket"), F.col("wrap"), F.lit(1).alias("ghost"))
    rows = rows.withColumn("place", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, sent))))
    rows = rows.select("id", "none", "key", F.xxhash64("text").alias("tie"), "text", "sketch", "place.bucket", "place.wrap", "place.ghost")
    w = Window.partitionBy("bucket").orderBy("wrap", "none", "key", "tie", "ghost")
    follow = F.lead(F.struct("text", "sketch")).over(w)
    return rows.withColumn("following", follow).filter("ghost = 0").select("id", "text", "sketch", F.col("following.text").alias("next_text"), F.col("following.sketch").alias("next_sketch"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_chars, text, sketch, edited, edited_sketch, next_sketch.

    edited: the last half of the code points (rounded down) replaced by as many of the next document's first, or all of
    them. A lone document is its own next one. Empty texts have empty sketches. An empty table gives an empty result;
    repeated rows stay repeated; other columns are ignored.
    """
    rows = beside_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    rows = rows.select(F.col("id").alias(id_col), "n_chars", "text", "sketch", edited.alias("edited"), "next_sketch")
    return rows.withColumn("edited_sketch", sketch(F.col("edited")))


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return rows.select(
        id_col,
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_of(F.col("sketch")).alias("fingerprint"),
        text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
