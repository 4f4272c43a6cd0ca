"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every text is a blob, named by its SHA-256. The ledger holds, for each (blob, rule version) scanned, its findings. A
scan takes the blobs of the given rows, drops the pairs that the ledger has, scans each remaining blob once, however
many rows have it, and joins the ledger's findings, old and new, back to all rows. A text is read once: for its name, and
to see whether some rule can match at all. Only texts where one can go on to the ledger and to the scan.

Spans come from lengths alone: a text is split at a rule's matches, and the lengths of pieces and matches, summed up
by a window over the matches of a blob and rule, say where each match stands, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import durable, exists


@dataclass(frozen=True)
class Rule:
    """pattern: what matches; ready: what a text with a match that counts has; value: the value behind this prefix has 8 characters or more."""

    kind: str
    pattern: str
    ready: str
    value: str = ""
    base: bool = False


VALUE = "[A-Za-z0-9+/_.=-]"
NAME = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = rf"""{NAME}["']?\x20*[:=]\x20*["']?"""
#: In the order in which spans with one start are listed. Each is leftmost and non-overlapping within its kind.
RULES = (
    # short values are matched and then dropped: what they cover can't start another match
    Rule("assign", f"{ASSIGN}{VALUE}+", f"{ASSIGN}{VALUE}{{8}}", f"^{ASSIGN}", True),
    Rule("access", "AKIA[A-Z0-9]{12,}", "AKIA[A-Z0-9]{12}", base=True),
    Rule("hex", "[0-9a-f]{32,}", "[0-9a-f]{32}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8}"),
    Rule("url-login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", r"://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)
RULE_VERSION = "2"


def blob_name(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


NONE = "array<struct<start:int,rank:int,stop:int>>"


def matches_of(rule: Rule, number: int) -> Column:
    """array<struct<rank, gap, size, keep>> of a rule's matches in column text, in order: gap is what lies before since the last one."""
    found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    pieces = F.split("text", rule.pattern, -1)
    zipped = F.arrays_zip(found.alias("m"), F.slice(pieces, F.lit(1), F.size(found)).alias("p"))
    made = F.transform(zipped, lambda x: F.struct(F.lit(number).alias("rank"), F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("size"), _keep(rule, x["m"]).alias("keep")))
    return F.when(F.col("text").rlike(rule.ready), made).otherwise(F.array().cast("array<struct<rank:int,gap:int,size:int,keep:boolean>>"))


def _keep(rule: Rule, match: Column) -> Column:
    return F.length(F.regexp_replace(match, rule.value, "")) >= 8 if rule.value else F.lit(True)


def may_match(text: Column, rules=RULES) -> Column:
    """Whether some rule can match in text."""
    return text.rlike("|".join(f"(?:{r.ready})" for r in rules))


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, spans) of (blob, text): spans by start, then rule; array<struct<start, rank, stop>>. Blobs without any are left out.

    Linear in the number of matches: they are rows, summed up over one blob and rule at a time.
    """
    rows = blobs.select("blob", F.posexplode(F.flatten(F.array(*(matches_of(r, k) for k, r in enumerate(rules))))).alias("at", "m")).select("blob", "at", "m.*")
    # partitioned by blob, as the grouping after it, so that one exchange serves both
    w = Window.partitionBy("blob", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ended = rows.repartition("blob").withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(w).cast("int")).filter("keep")
    span = F.struct((F.col("stop") - F.col("size")).alias("start"), "rank", "stop")
    return ended.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def listed(spans: Column, rules=RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def screened(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(id, blob, text), written: every row with its blob's name, and the text where some rule can match, else null."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return durable(docs.select(F.col(id_col).alias("id"), blob_name(text).alias("blob"), F.when(may_match(text, rules), text).alias("text")), "screened")


def scan_unseen(rows: DataFrame, ledger: DataFrame | None, rules=RULES, version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows (blob, rule_version, spans) of the blobs in screened rows that the ledger lacks for this version."""
    unseen, candidates = rows.select("blob"), rows.filter("text is not null").select("blob", "text")
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == version).select("blob").distinct()
        unseen, candidates = (x.join(known, "blob", "left_anti") for x in (unseen, candidates))
    hits = durable(scan_blobs(candidates.groupBy("blob").agg(F.any_value("text").alias("text")), rules), "hits")
    return unseen.distinct().join(hits, "blob", "left").select("blob", F.lit(version).alias("rule_version"), F.coalesce("spans", F.array().cast(NONE)).alias("spans"))


def findings(rows: DataFrame, ledger: DataFrame, id_col: str = "doc_id", version: str = RULE_VERSION) -> DataFrame:
    """Screened rows with what the ledger says of their blobs: id_col, blob, spans."""
    found = ledger.filter((F.col("rule_version") == version) & (F.size("spans") > 0)).select(F.col("blob").alias("b"), "spans").dropDuplicates(["b"])
    joined = rows.select("id", "blob").join(found, F.col("b") == F.col("blob"), "left")
    return joined.select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(NONE)).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules=RULES, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows).

    findings: one row per row of docs, with id_col, blob and spans (an empty array if there are none). Ledger rows are
    (blob, rule_version, spans), one per blob scanned, with findings or not. A null text counts as empty, which has no
    secrets; a text of any length and any number of matches is scanned whole; repeated rows stay repeated; an empty table
    gives empty results; other columns are ignored.
    """
    rows = screened(docs, id_col, text_col, rules)
    fresh = durable(scan_unseen(rows, ledger, rules, version), "fresh")
    return findings(rows, fresh if ledger is None else ledger.select(*fresh.columns).unionByName(fresh), id_col, version), fresh


def scan_into(path: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, version: str = RULE_VERSION) -> DataFrame:
    """The findings of scan() by the ledger table at path, to which the pairs scanned now are appended.

    The table is made if it isn't there. All findings, old and new, are read back from it.
    """
    spark = docs.sparkSession
    rows = screened(docs, id_col, text_col, rules)
    scan_unseen(rows, spark.read.parquet(path) if exists(spark, path) else None, rules, version).write.mode("append").parquet(path)
    return findings(rows, spark.read.parquet(path), id_col, version)


def digest(findings: DataFrame, id_col: str = "doc_id", rules=RULES) -> DataFrame:
    """id_col, n_<kind> for the base kinds, base_sha256, spans as text."""
    base = [k for k, r in enumerate(rules) if r.base]

    def of(k: int):
        return lambda s: s["rank"] == k

    counts = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{rules[k].kind}") for k in base]
    own = F.filter("spans", lambda s: s["rank"].isin(base))
    return findings.select(id_col, *counts, F.sha2(listed(own, rules).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans"), rules).alias("spans"))
