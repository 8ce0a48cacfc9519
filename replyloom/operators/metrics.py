"""Class balance, confusion counts, cost, agreement and pairwise judgements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom import defaults as D
from replyloom.functions.judge import judge, kappa_band, score_tier
from replyloom.functions.judge import RubricWords


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of each class."""
    total = df.agg(F.count(F.lit(1)))
    return (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("share", F.col("rows") / total.scalar())
    )


def distinct_classes(df: DataFrame, label: str) -> DataFrame:
    """The classes that occur."""
    return df.select(label).distinct()


def confusion(df: DataFrame, by: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """True and false positives and negatives of 0/1 columns, per group."""
    truth, said = F.col(y) == 1, F.col(pred).cast("int") == 1
    return df.groupBy(*by).agg(
        F.count_if(truth & said).alias("tp"),
        F.count_if(~truth & said).alias("fp"),
        F.count_if(~truth & ~said).alias("tn"),
        F.count_if(truth & ~said).alias("fn"),
    )


def add_binary_metrics(
    counts: DataFrame, c_fn: float = D.COST_MISS, c_fp: float = D.COST_FALSE_ALARM
) -> DataFrame:
    """Precision, recall, F1 and cost from confusion counts."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    one = F.lit(1.0)
    precision, recall = tp / F.greatest(one, tp + fp), tp / F.greatest(one, tp + fn)
    return (
        counts.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn(
            "f1",
            F.lit(2.0) * F.col("precision") * F.col("recall")
            / F.greatest(F.lit(1e-8), F.col("precision") + F.col("recall")),
        )
        .withColumn("cost", fn * F.lit(float(c_fn)) + fp * F.lit(float(c_fp)))
    )


def binary_metrics(
    df: DataFrame,
    by: Sequence[str] = (),
    y: str = "y",
    pred: str = "pred",
    c_fn: float = D.COST_MISS,
    c_fp: float = D.COST_FALSE_ALARM,
) -> DataFrame:
    """Confusion counts with precision, recall, F1 and cost per group."""
    return add_binary_metrics(confusion(df, by, y, pred), c_fn, c_fp)


def grounding(
    top_resolution: Column, escalated: Column, y: Column, static_system: Column
) -> Column:
    """Grounding of one reply: trusted source or right escalation 1, else by kind of system."""
    return (
        F.when(F.coalesce(top_resolution, F.lit(0.0)) >= D.TRUSTED_RESOLUTION, F.lit(1.0))
        .when(escalated & (y == 1), F.lit(1.0))
        .when(static_system, F.lit(0.20))
        .otherwise(F.lit(0.50))
    )


def cohen_kappa(
    df: DataFrame, a: str, b: str, by: Sequence[str] = (), degenerate: Column | None = None
) -> DataFrame:
    """Rows, observed agreement and Cohen's kappa of two label columns.

    Rows are counted per pair of labels first; each pair then adds to both marginals, so one more
    small aggregate gives the chance agreement. Where chance agreement is 1 kappa is null, or the
    ``degenerate`` column over (n, agreement).
    """
    by = list(by)
    pairs = df.groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(
        F.count(F.lit(1)).cast("double").alias("_n")
    )
    zero = F.lit(0.0)
    same = F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(zero)
    marginals = (
        pairs.select(
            *by,
            F.inline(
                F.array(
                    F.struct(
                        F.col("_a").cast("string").alias("label"), F.col("_n").alias("left"),
                        zero.alias("right"), same.alias("same"),
                    ),
                    F.struct(
                        F.col("_b").cast("string").alias("label"), zero.alias("left"),
                        F.col("_n").alias("right"), zero.alias("same"),
                    ),
                )
            ),
        )
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("left", "right", "same")])
        .groupBy(*by)
        .agg(
            F.sum("left").alias("n"),
            (F.sum("same") / F.sum("left")).alias("agreement"),
            (F.sum(F.col("left") * F.col("right")) / F.sum("left") / F.sum("left")).alias("_pe"),
        )
    )
    fallback = F.lit(None).cast("double") if degenerate is None else degenerate
    kappa = F.when(F.col("_pe") >= 1.0, fallback).otherwise(
        (F.col("agreement") - F.col("_pe")) / (F.lit(1.0) - F.col("_pe"))
    )
    return marginals.select(
        *by, F.col("n").cast("long").alias("n"), "agreement", kappa.alias("kappa")
    )


def agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement rate, number and share of rows on which two label columns differ."""
    differs = F.col(a) != F.col(b)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((~differs).cast("int")).alias("agreement"),
        F.count_if(differs).alias("drift_count"),
        F.avg(differs.cast("int")).alias("drift_share"),
    )


def disagreements(
    scores: DataFrame, threshold: float = D.LARGE_DELTA, delta: str = "delta_score"
) -> DataFrame:
    """Rows whose two scores lie far apart."""
    return scores.where(F.coalesce(F.col(delta), F.lit(0.0)) >= threshold)


def drift_cases(relabels: DataFrame, flag: str = "is_consistent") -> DataFrame:
    """Rows whose second label differs; a missing flag counts as consistent."""
    return relabels.where(~F.coalesce(F.col(flag), F.lit(True)))


def agreement_study(
    scores: DataFrame,
    human: str = "human_overall_score",
    machine: str = "machine_overall_score",
    delta: str = "delta_score",
) -> DataFrame:
    """One row: cases, kappa of the score tiers, its reading, and large disagreements."""
    tiers = scores.select(
        score_tier(F.col(human)).alias("h"), score_tier(F.col(machine)).alias("m")
    )
    large = disagreements(scores, delta=delta).agg(F.count(F.lit(1)))
    return cohen_kappa(tiers, "h", "m").select(
        F.col("n").alias("total_cases"),
        F.col("kappa").alias("cohens_kappa"),
        kappa_band(F.col("kappa")).alias("interpretation"),
        large.scalar().alias("large_disagreements"),
    )


def relabel_audit(
    gold: DataFrame,
    relabels: DataFrame,
    first: str = "original_escalate",
    second: str = "blind_relabel_escalate",
    id_col: str = "id",
    examples: int = 3,
) -> DataFrame:
    """One row: sizes, agreement, kappa, drift and the ids of a few drifted cases."""
    total = gold.agg(F.count(F.lit(1)))
    drifted = drift_cases(relabels)
    # exactly ``examples`` ids at most
    shown = drifted.orderBy(id_col).limit(examples).agg(
        F.array_join(F.array_sort(F.collect_list(F.col(id_col))).cast("array<string>"), ",")
    )
    only = F.when(F.col("agreement") == 1.0, F.lit(1.0)).otherwise(F.lit(0.0))
    return cohen_kappa(relabels, first, second, degenerate=only).select(
        total.scalar().alias("total_gold"),
        F.col("n").alias("audit_size"),
        "agreement",
        "kappa",
        drifted.agg(F.count(F.lit(1))).scalar().alias("drift_cases"),
        shown.scalar().alias("drift_examples"),
    )


def position_inconsistency(trials: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How much the winner depends on which answer is shown first.

    ``trials`` has one row per pair with 0/1 columns ``a_first_win`` (A won when shown first) and
    ``b_first_win`` (B won when shown first).
    """
    n = F.count(F.lit(1))
    return trials.groupBy(*by).agg(
        n.alias("trials"),
        (F.abs(F.sum("a_first_win") - (n - F.sum("b_first_win"))) / n).alias("inconsistency"),
    )


def pairwise_score(trials: DataFrame) -> DataFrame:
    """Two-way score of each ordered pair: 0.5 * (win(A, B) + 1 - win(B, A)).

    ``trials`` has (item, first, second, win) with both orders of each pair.
    """
    swapped = trials.select(
        "item", F.col("first").alias("second"), F.col("second").alias("first"),
        F.col("win").alias("_back"),
    )
    return trials.join(swapped, ["item", "first", "second"]).select(
        "item", "first", "second",
        (F.lit(0.5) * (F.col("win") + F.lit(1) - F.col("_back"))).alias("score"),
    )


def judge_gap(
    pairs: DataFrame,
    query: str = "query",
    left: str = "left_reply",
    right: str = "right_reply",
    words: RubricWords = RubricWords(),
) -> DataFrame:
    """Score of the right reply minus the left one, with and without the length penalty."""

    def overall(reply: str, mitigate: bool) -> Column:
        return judge(F.col(query), F.col(reply), mitigate=mitigate, words=words)["overall_score"]

    scored = pairs.withColumns(
        {
            "left_score": overall(left, True), "right_score": overall(right, True),
            "_left": overall(left, False), "_right": overall(right, False),
        }
    )
    return scored.withColumns(
        {
            "unmitigated_gap": F.round(F.col("_right") - F.col("_left"), 2),
            "mitigated_gap": F.round(F.col("right_score") - F.col("left_score"), 2),
        }
    ).drop("_left", "_right")
