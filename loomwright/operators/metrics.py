"""Evaluation: confusion matrices, ROC points, step and exact area, deciles and errors by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.running import previous, running_sums


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: n00, n01, n10, n11 (label, then prediction)."""
    cell = lambda y, p: F.count_if((F.col(label) == y) & (F.col(predicted) == p)).alias(f"n{y}{p}")
    return df.agg(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1))


def confusion_rates(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Row shares of the confusion matrix, accuracy and error."""
    c = confusion(df, label, predicted)
    row0, row1, n = F.expr("n00 + n01"), F.expr("n10 + n11"), F.expr("n00 + n01 + n10 + n11")
    share = lambda a, b: F.round(F.try_divide(F.col(a), b), 6)
    return c.select(share("n00", row0).alias("tn_rate"), share("n01", row0).alias("fp_rate"), share("n10", row1).alias("fn_rate"), share("n11", row1).alias("tp_rate"), F.round(F.expr("n00 + n11") / n, 6).alias("accuracy"), F.round(F.expr("n01 + n10") / n, 6).alias("error"))


def roc(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """(p, tp, fp, pos, neg): for each different score, positives and negatives with a higher score, and all of both."""
    groups = df.groupBy(F.col(score).cast("double").alias("p")).agg(F.sum(label).alias("g1"), F.sum(1 - F.col(label)).alias("g0"))
    totals = df.agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    run = running_sums(groups, "p", ["g1", "g0"])
    return run.select("p", (F.col("run_g1") - F.col("g1")).alias("tp"), (F.col("run_g0") - F.col("g0")).alias("fp"), "g1", "g0").crossJoin(F.broadcast(totals))  # one row


def roc_points(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """(p, fpr, tpr) at each different score: shares of what scores higher."""
    return roc(df, label, score).select("p", F.round(F.col("fp") / F.col("neg"), 6).alias("fpr"), F.round(F.col("tp") / F.col("pos"), 6).alias("tpr"))


def falling_steps(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """One row: n points of the curve and n_falling, those where a rate is below that of the next higher score."""
    held = previous(roc(df, label, score), "p", ["tp", "fp"])
    return held.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("tp") < F.col("prev_tp")) | (F.col("fp") < F.col("prev_fp"))).alias("n_falling"))


def auc(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """One row: auc_step (left sums, without the segment of the least score) and auc_exact (ties count half)."""
    r = roc(df, label, score)
    # a score's own negatives span the step from fp to fp + g0; the least score's step is left out of auc_step
    least = r.agg(F.min("p").alias("least")).first()["least"]
    step = F.sum(F.when(F.col("p") > F.lit(least), F.col("tp") * F.col("g0"))) / F.max("pos") / F.max("neg")
    exact = F.sum((F.col("tp") + F.col("g1") / 2) * F.col("g0")) / F.max("pos") / F.max("neg")
    return r.agg(F.round(step, 6).alias("auc_step"), F.round(exact, 6).alias("auc_exact"))


def errors_by_label(df: DataFrame, label: str = "label", score: str = "p", threshold: float = 0.5) -> DataFrame:
    """Deciles of the score, and how often the prediction is wrong, for each label."""
    wrong = (F.col(score) >= threshold).cast("int") != F.col(label)
    deciles = F.percentile(score, F.array(*(F.lit(k / 10) for k in range(11))))
    held = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("n_wrong"), deciles.alias("d"))
    return held.select(F.col(label).alias("label"), "n", "n_wrong", F.posexplode("d").alias("decile", "value")).withColumn("value", F.round("value", 6))


def prune_negatives(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """df without the negatives that score below max(least positive score, min(0.5, 5% quantile of the negatives))."""
    bound = df.agg(
        F.greatest(F.min(F.when(F.col(label) == 1, F.col(score))), F.least(F.lit(0.5), F.percentile(F.when(F.col(label) == 0, F.col(score)), 0.05))).alias("bound")
    )
    return df.crossJoin(F.broadcast(bound)).filter(~((F.col(label) == 0) & (F.col(score) < F.col("bound")))).drop("bound")  # one row


def top_bottom(scores: DataFrame, key: str, k: int, score: str = "score") -> DataFrame:
    """The k highest scores of those above 0 and the k lowest of those below 0, with their sides."""
    high = scores.orderBy(F.desc(score), key).limit(k).filter(F.col(score) > 0).withColumn("side", F.lit("pos"))
    low = scores.orderBy(score, F.desc(key)).limit(k).filter(F.col(score) < 0).withColumn("side", F.lit("neg"))
    return high.unionByName(low)


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
