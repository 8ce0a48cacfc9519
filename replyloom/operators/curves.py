"""Threshold, precision-recall and ROC curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from replyloom import defaults as D
from replyloom.operators.metrics import add_binary_metrics
from replyloom.runtime import bin_index, materialize, running_sums


def cost_curve(
    scored: DataFrame,
    thresholds: Sequence[float] = D.THRESHOLDS,
    c_fn: float = D.COST_MISS,
    c_fp: float = D.COST_FALSE_ALARM,
    p: str = "p",
    y: str = "y",
) -> DataFrame:
    """Metrics and cost of ``p >= threshold`` for each threshold.

    Rows are never multiplied by the thresholds: each row falls into the bin of the largest
    threshold it reaches, and sums over the at most len(thresholds) + 1 bins give all counts.
    """
    cuts = sorted(float(t) for t in thresholds)
    bins = (
        scored.groupBy(bin_index(F.col(p), cuts).alias("bin"))
        .agg(
            F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
        )
    )
    every = scored.sparkSession.createDataFrame(
        [(i, float(cuts[i - 1]) if i else None) for i in range(len(cuts) + 1)],
        "bin int, threshold double",
    )
    up = W.partitionBy(F.lit(0)).orderBy(F.desc("bin"))  # one row per threshold
    everything = W.partitionBy(F.lit(0))
    pos, neg = F.coalesce("pos", F.lit(0)), F.coalesce("neg", F.lit(0))
    counts = (
        every.join(bins, "bin", "left")
        .select(
            "bin",
            "threshold",
            F.sum(pos).over(up).alias("tp"),
            F.sum(neg).over(up).alias("fp"),
            F.sum(pos).over(everything).alias("_pos"),
            F.sum(neg).over(everything).alias("_neg"),
        )
        .where(F.col("bin") > 0)
        .select(
            (F.col("bin") - 1).alias("i"), "threshold", "tp", "fp",
            (F.col("_neg") - F.col("fp")).alias("tn"), (F.col("_pos") - F.col("tp")).alias("fn"),
        )
    )
    return add_binary_metrics(counts, c_fn, c_fp)


def best_threshold(curve: DataFrame) -> DataFrame:
    """The first row of a cost curve with minimal cost."""
    row = F.struct(*curve.columns)
    return curve.agg(F.min_by(row, F.struct("cost", "threshold")).alias("r")).select("r.*")


def sample_curve(curve: DataFrame, step: int = 10) -> DataFrame:
    """Every ``step``-th row of a cost curve."""
    return curve.where(F.col("i") % step == 0)


def _by_score(scored: DataFrame, p: str, y: str) -> DataFrame:
    """Cumulative positives and negatives from the highest score down, one row per score."""
    counts = scored.groupBy(F.col(p).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")
    )
    return running_sums(
        counts, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}
    ).select("score", "pos", "neg", "tp", "fp")


def pr_curve(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(score, precision, recall) per distinct score, and the end point (1, 0)."""
    by_score = materialize(_by_score(scored, p, y), "scores")
    positives = by_score.agg(F.sum("pos").cast("double"))
    curve = by_score.select(
        "score",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / positives.scalar()).alias("recall"),
    )
    end = scored.sparkSession.createDataFrame(
        [(None, 1.0, 0.0)], "score double, precision double, recall double"
    )
    return curve.unionByName(end)


def roc_curve(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """(score, fpr, tpr) per distinct score, and the start point (0, 0)."""
    by_score = materialize(_by_score(scored, p, y), "scores")
    totals = by_score.agg(
        F.struct(F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"))
    )
    all_rows = totals.scalar()
    curve = by_score.select(
        "score",
        (F.col("fp") / all_rows["n"]).alias("fpr"),
        (F.col("tp") / all_rows["p"]).alias("tpr"),
    )
    start = scored.sparkSession.createDataFrame(
        [(None, 0.0, 0.0)], "score double, fpr double, tpr double"
    )
    return curve.unionByName(start)


def areas(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """One row (pr_auc, roc_auc) by trapezoids, from one sort of the scores.

    The previous point of a score follows from its own counts, so no ordering of the points is needed
    beyond the running sums.
    """
    by_score = materialize(_by_score(scored, p, y), "scores")
    totals = by_score.agg(
        F.struct(F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"))
    )
    all_rows = totals.scalar()
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    roc = (fp - fp0) * (tp + tp0) / F.lit(2.0) / all_rows["n"] / all_rows["p"]
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0))
    pr = (tp - tp0) / all_rows["p"] * (tp / (tp + fp) + before) / F.lit(2.0)
    return by_score.agg(F.sum(pr).alias("pr_auc"), F.sum(roc).alias("roc_auc"))


def pr_auc(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Area under the precision-recall curve by trapezoids."""
    return areas(scored, p, y).select("pr_auc")


def roc_auc(scored: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Area under the ROC curve by trapezoids."""
    return areas(scored, p, y).select("roc_auc")
