"""Escalation: classifiers, guardrail override, calibration, protection check."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom import defaults as D
from replyloom.functions.rules import coarse_class, guardrail
from replyloom.operators.curves import areas, best_threshold, cost_curve
from replyloom.operators.metrics import class_balance
from replyloom.operators.tfidf import (
    ESCALATION_CONFIG, INTENT_CONFIG, TfidfConfig, TfidfModel, tfidf_fit,
)
from replyloom.runtime import materialize

Rules = Sequence[tuple[str, str]]
#: Sums of the gradient check that reach the driver at most.
GRADIENT_PARTS = 16


@dataclass(frozen=True)
class TextClassifier:
    """A logistic regression over TF-IDF vectors. ``classes[i]`` names probability i.

    ``violation`` is the largest component of the gradient of the penalised average loss at the fit:
    0 at the optimum, which is unique.
    """

    tfidf: TfidfModel
    model: LogisticRegressionModel
    classes: tuple[str, ...]
    violation: float = float("nan")

    def probabilities(self, df: DataFrame, text: str, output: str = "_probabilities") -> DataFrame:
        """Adds the array of class probabilities."""
        vectors = self.tfidf.transform(df, text, "_vector")
        scored = self.model.transform(vectors)
        extra = ("_vector", "_raw", "_probability", "_prediction")
        return scored.withColumn(output, vector_to_array("_probability")).drop(*extra)


def _fit(
    df: DataFrame, text: str, label: Column, weight: Column, reg: float, config: TfidfConfig,
    classes: tuple[str, ...], iterations: int,
) -> TextClassifier:
    tfidf = tfidf_fit(df, text, config)
    # every iteration reads the vectors, not the texts
    rows = materialize(
        tfidf.transform(df, text, "_vector").select(
            "_vector", label.cast("double").alias("_label"), weight.alias("_weight")
        ),
        "training",
    )
    regression = LogisticRegression(
        featuresCol="_vector", labelCol="_label", weightCol="_weight", predictionCol="_prediction",
        probabilityCol="_probability", rawPredictionCol="_raw", regParam=reg, elasticNetParam=0.0,
        standardization=False, maxIter=iterations, tol=1e-6,
        family="binomial" if len(classes) == 2 else "multinomial",
    )
    fitted = regression.fit(rows)
    return TextClassifier(tfidf, fitted, classes, _violation(rows, fitted, reg))


def _violation(rows: DataFrame, model: LogisticRegressionModel, reg: float) -> float:
    """Largest component of the gradient, in one pass: every task adds up its rows."""
    binary = model.numClasses == 2
    coefficients, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    if binary:
        coefficients, intercepts = np.vstack([0 * coefficients, coefficients]), np.append(0.0, intercepts)
    k, width = coefficients.shape
    shared = rows.sparkSession.sparkContext.broadcast((coefficients, intercepts))  # classes x vocabulary

    def work(batches):
        c, b = shared.value
        total = np.zeros((k, width + 2))
        for batch in batches:
            lengths = np.diff(batch.column("positions").offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), lengths)
            position, value = (batch.column(n).flatten().to_numpy() for n in ("positions", "values"))
            weight, label = batch.column("_weight").to_numpy(), batch.column("_label").to_numpy().astype(int)
            margin = np.stack([np.bincount(row, value * c[j, position], batch.num_rows) + b[j] for j in range(k)], axis=1)
            p = np.exp(margin - margin.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(p)), label] -= 1.0
            p *= weight[:, None]
            for j in range(k):
                total[j, :width] += np.bincount(position, value * p[row, j], width)
            total[:, width] += p.sum(axis=0)
            total[:, width + 1] += weight.sum()
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (total,)], ["total"])

    raw = F.unwrap_udt(F.col("_vector"))
    sparse = rows.select(raw["indices"].alias("positions"), raw["values"].alias("values"), "_label", "_weight")
    # a matrix of classes x vocabulary for each task, added up in a few groups before the driver
    parts = sparse.mapInArrow(work, "total binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GRADIENT_PARTS)))

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in group.column("total"))
        return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

    sums = parts.groupBy("part").applyInArrow(add, "total binary").collect()
    total = sum(np.frombuffer(r["total"]) for r in sums).reshape(k, width + 2)
    n = max(float(total[0, width + 1]), 1e-300)
    gradient = total[:, :width] / n + reg * coefficients
    if binary:
        gradient = gradient[1:]
    return float(max(np.abs(gradient).max(initial=0.0), np.abs(total[-1 if binary else slice(None), width] / n).max()))


def fit_escalation(
    gold: DataFrame, text: str = "text", y: str = "y", c: float = 1.0,
    config: TfidfConfig = ESCALATION_CONFIG,
) -> TextClassifier:
    """Binary classifier with L2 penalty and balanced class weights.

    The balanced weights n / (2 n_c) sum to n, so the penalty per average loss is 1 / (c n).
    """
    counts = {r[y]: r["rows"] for r in class_balance(gold, y).limit(3).collect()}
    if len(counts) != 2:
        raise ValueError(f"{len(counts)} classes in {y}, 2 are needed")
    n = sum(counts.values())
    weight = F.when(F.col(y) == 1, F.lit(n / (2.0 * counts[1]))).otherwise(
        F.lit(n / (2.0 * counts[0]))
    )
    return _fit(gold, text, F.col(y), weight, 1.0 / (c * n), config, ("0", "1"), 100)


def fit_intent(
    gold: DataFrame, text: str = "text", category: str = "category", c: float = 1.0,
    config: TfidfConfig = INTENT_CONFIG, classes=D.COARSE_CLASSES, default: str = D.COARSE_DEFAULT,
) -> TextClassifier:
    """Multinomial classifier of the coarse class, at most 200 iterations."""
    named = gold.withColumn("_class", coarse_class(F.col(category), classes, default))
    counts = {r["_class"]: r["rows"] for r in class_balance(named, "_class").collect()}
    present = tuple(sorted(counts))  # at most the listed classes and the default
    label = F.array_position(F.array(*[F.lit(c) for c in present]), F.col("_class")) - 1
    n = sum(counts.values())
    return _fit(named, text, label, F.lit(1.0), 1.0 / (c * n), config, present, 200)


def hybrid_probability(
    df: DataFrame, text: str = "text", p: str = "p", rules: Rules = D.GUARDRAIL, group: int = 0
) -> DataFrame:
    """Probability 1.0 wherever the guardrail hits; keeps the hit in the column ``hit``."""
    return df.withColumn("hit", guardrail(F.col(text), rules, group)).withColumn(
        p, F.when(F.col("hit").isNotNull(), F.lit(1.0)).otherwise(F.col(p))
    )


def calibrate_scores(
    scored: DataFrame,
    c_fn: float = D.COST_MISS,
    c_fp: float = D.COST_FALSE_ALARM,
    thresholds: Sequence[float] = D.THRESHOLDS,
) -> DataFrame:
    """One row: best threshold with its metrics, both areas, and the number of guardrail hits.

    ``scored`` has columns y, p and hit, as ``hybrid_probability`` returns them.
    """
    curve = cost_curve(scored, thresholds, c_fn, c_fp)
    hits = scored.agg(F.count("hit"))
    both = areas(scored).select(F.struct("pr_auc", "roc_auc")).scalar()
    return best_threshold(curve).select(
        "threshold", "precision", "recall", "f1", "fn", "fp", "tp", "tn", "cost",
        both["pr_auc"].alias("pr_auc"),
        both["roc_auc"].alias("roc_auc"),
        hits.scalar().alias("guardrail_hits"),
    )


def split_holdout(gold: DataFrame, id_col: str, holdout: float) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a digest of the id; without a holdout both are all rows."""
    if not holdout:
        return gold, gold
    bucket = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1000))
    cut = int(holdout * 1000)
    return gold.where(bucket >= cut), gold.where(bucket < cut)


def calibrate(
    gold: DataFrame,
    text: str = "text",
    y: str = "y",
    c_fn: float = D.COST_MISS,
    c_fp: float = D.COST_FALSE_ALARM,
    rules: Rules = D.GUARDRAIL,
    group: int = 0,
    holdout: float = 0.0,
    id_col: str = "id",
    config: TfidfConfig = ESCALATION_CONFIG,
) -> tuple[TextClassifier, DataFrame]:
    """Fit, override by the guardrail, and choose the cheapest threshold.

    By default the rows scored are the rows fitted on; ``holdout`` keeps a share apart.
    """
    train, test = split_holdout(gold, id_col, holdout)
    classifier = fit_escalation(train, text, y, config=config)
    scored = classifier.probabilities(test, text).select(
        F.col(text).alias("text"), F.col(y).alias("y"), F.col("_probabilities")[1].alias("p")
    )
    hybrid = hybrid_probability(scored, rules=rules, group=group).select("y", "p", "hit")
    return classifier, calibrate_scores(materialize(hybrid, "scores"), c_fn, c_fp)


def protection_check(
    cases: DataFrame,
    query: str = "query",
    confidence: str = "confidence",
    cutoff: float = D.PROTECTION_CUTOFF,
    rules: Rules = D.GUARDRAIL,
    group: int = 0,
) -> DataFrame:
    """Does the guardrail still catch a case that a classifier is confidently wrong about?"""
    hit = F.col("_hit").isNotNull()
    escalate = hit | (F.col(confidence) < F.lit(cutoff))
    return (
        cases.withColumn("_hit", guardrail(F.col(query), rules, group))
        .withColumns(
            {
                "guardrail_triggered": hit,
                "guardrail_category": F.col("_hit.category"),
                "matched_token": F.col("_hit.phrase"),
                "final_decision": F.when(escalate, "ESCALATED").otherwise("NOT_ESCALATED"),
                "proof_status": F.when(escalate & hit, "PROTECTED").otherwise("VULNERABLE"),
            }
        )
        .drop("_hit")
    )
