"""Quality by hierarchical empirical Bayes: a document's own evidence and that of its host and path.

A logistic classifier on shape measures of the text gives every document a probability. Hosts and paths
gather labelled outcomes and, with less weight, the probabilities of unlabelled documents. Host rates are shrunk
towards the global rate and path rates towards their host's, by strengths that moments of the grouped
rates give (beta-binomial), so sparse sites stay near the prior. A document's odds are its own times those of
its path against the global rate; its own share of the sums is taken out first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.llm.blocks import texts_of
from replyloom.llm.quality_rules import _measure
from replyloom.runtime import materialize, salted_join

#: Most labelled rows the classifier learns from; weight of an unlabelled document in its site.
SAMPLE_ROWS, SOFT = 40_000, 0.25
FEATURES = 9
_UPPER = bytes(set(range(256)) - set(range(0x41, 0x5B)))
_MARKS = bytes(set(range(256)) - set(b"!?"))


def _shape(text: bytes) -> list[float]:
    words, chars, symbols, lines, dup, repeated = _measure(text)
    w, c = max(words, 1), max(chars, 1)
    return [
        float(np.log1p(words)), min(chars / w, 50.0) / 10, symbols / c, dup / max(lines, 1), repeated / w,
        len(text.translate(None, _UPPER)) / c, len(text.translate(None, _MARKS)) / w,
        len(set(text.split())) / w, float(words < 30),
    ]


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps; the last is the constant."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return np.append(np.zeros(FEATURES), np.log(rate / (1 - rate)))
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.append(np.full(FEATURES, 1.0), 1e-3)
        move = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def _strength(groups: DataFrame, parent: str) -> float:
    """Prior observations that the spread of group rates around ``parent`` rates supports."""
    r = groups.agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(parent), 2)).alias("spread"),
        F.sum(F.col(parent) * (1 - F.col(parent))).alias("noise"),
        F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))).alias("scale"),
        F.sum("n").alias("n"),
    ).first()
    if not r["n"]:
        return 1.0
    between = ((r["spread"] or 0.0) - (r["noise"] or 0.0)) / r["n"]
    inside = (r["scale"] or 0.0) / r["n"]
    return float(min(max(inside / between - 1, 1.0), 1e6)) if between > 0 else 1e6


def site_quality(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, label: str = "quality",
    text: str = "text", doc_id: str = "doc_id", rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(doc_id, host, path, p_text, p_site, score) of every row of ``docs``.

    ``p_text`` is the classifier's probability of label 1, ``p_site`` the posterior rate of the path
    without the document itself, ``score`` both together. ``path`` names a part of a host. Null hosts or paths count as empty names. Of
    several labels of an id the largest counts. Null and empty texts are scored by their measures (all zero). Without labels
    every rate is 0.5. Repeated rows and null ids keep their rows; other columns are dropped.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(
        F.col(doc_id).cast("long").alias("doc_id")
    ).agg(F.max(F.col(label).cast("int")).alias("y"))

    def measure(batches):
        for batch in batches:
            shapes = np.array([_shape(t) for t in texts_of(batch.column("_text"))], np.float64).reshape(-1, FEATURES)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(shapes) + 1, dtype=np.int32) * FEATURES), pa.array(shapes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], flat], ["doc_id", "host", "path", "shape"])

    shaped = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text).cast("string").alias("_text"),
    ).mapInArrow(measure, "doc_id long, host string, path string, shape array<double>")
    table = materialize(shaped.join(known, "doc_id", "left"), "shapes")

    sample = table.where(F.col("y").isNotNull()).select("doc_id", "shape", "y").orderBy(F.xxhash64("doc_id"), "shape").limit(rows).toArrow()
    x = np.array(sample.column("shape").to_pylist(), np.float64).reshape(-1, FEATURES)
    w = _fit(x, sample.column("y").to_numpy().astype(np.float64))
    odds = sum((F.get("shape", i) * F.lit(float(w[i])) for i in range(FEATURES)), F.lit(float(w[-1])))
    scored = table.select(
        "doc_id", "host", "path", "y", (1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))).alias("p_text")
    ).withColumns({
        "_w": F.when(F.col("y").isNotNull(), F.lit(1.0)).otherwise(F.lit(SOFT)),
        "_s": F.when(F.col("y").isNotNull(), F.col("y").cast("double")).otherwise(F.lit(SOFT) * F.col("p_text")),
    })
    paths = materialize(
        scored.groupBy("host", "path").agg(F.sum("_w").alias("n"), F.sum("_s").alias("s"), F.count(F.lit(1)).alias("rows")), "sites"
    )
    totals = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("rows").alias("rows"), F.max("rows").alias("top")).first()
    mean = min(max((totals["s"] or 0.0) / totals["n"], 1e-6), 1 - 1e-6) if totals["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    host_strength = _strength(hosts.withColumn("mean", F.lit(mean)), "mean")
    named = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    both = paths.join(named, "host")
    rate = (F.col("host_s") + host_strength * mean) / (F.col("host_n") + host_strength)
    path_strength = _strength(both.withColumn("rate", rate), "rate")

    met = salted_join(
        scored, both.select("host", "path", "n", "s", "host_n", "host_s"), ["host", "path"], spread=["doc_id", "p_text"],
        load=(totals["rows"] or 0, totals["top"] or 0),
    )
    of_host = (F.col("host_s") - F.col("_s") + host_strength * mean) / (F.col("host_n") - F.col("_w") + host_strength)
    of_path = (F.col("s") - F.col("_s") + path_strength * of_host) / (F.col("n") - F.col("_w") + path_strength)
    of_path = F.greatest(F.least(of_path, F.lit(1 - 1e-6)), F.lit(1e-6))

    def logit(p: Column) -> Column:
        return F.log(p / (1 - p))

    own = F.greatest(F.least(F.col("p_text"), F.lit(1 - 1e-9)), F.lit(1e-9))
    done = met.withColumn("p_site", of_path)
    return done.select(
        "doc_id", "host", "path", "p_text", "p_site",
        (1 / (1 + F.exp(-(logit(own) + logit(F.col("p_site")) - F.lit(float(np.log(mean / (1 - mean)))))))).alias("score"),
    )
