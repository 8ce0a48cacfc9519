"""Topic model: non-negative factorisation of sparse term weights, alternating least squares.

With the topic table H given, the topic weights of a text solve a small non-negative least squares
problem of their own; with all of them given, H follows from two sums over the texts, W^T X and W^T W. So
a round is one scan of the written terms: every task solves for its texts by coordinate descent, adds up
both sums, and forgets the weights. H has k x vocabulary numbers, bounded by the vocabulary
size; it is broadcast, and solved for on the driver by coordinate descent as well.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from replyloom.operators.tfidf import TfidfModel
from replyloom.runtime import materialize

_TINY = 1e-12
#: Sweeps of coordinate descent at most, and the change at which a sweep is the last one.
SWEEPS, STILL = 200, 1e-6


@dataclass(frozen=True)
class TopicModel:
    """``texts`` has (keys, topics array<double>); ``topics`` is k x vocabulary.

    ``violation`` is the sum of the projected gradient of H over that of the first round.
    """

    texts: DataFrame
    topics: np.ndarray
    losses: tuple[float, ...]
    converged: bool = False
    violation: float = 1.0


def non_negative(gram: np.ndarray, goal: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Least squares min x G x / 2 - g x with x >= 0 for every row of ``goal``, by coordinate descent."""
    x = x.copy()
    step = np.maximum(np.diag(gram), _TINY)
    open_rows = np.arange(len(x))
    for _ in range(SWEEPS):
        own, target = x[open_rows], goal[open_rows]
        moved = np.zeros(len(own))
        for j in range(len(gram)):
            new = np.maximum(0.0, own[:, j] - (own @ gram[:, j] - target[:, j]) / step[j])
            moved = np.maximum(moved, np.abs(new - own[:, j]))
            own[:, j] = new
        x[open_rows] = own
        open_rows = open_rows[moved > STILL * np.maximum(own.max(axis=1), _TINY)]
        if not len(open_rows):
            break
    return x


def _texts(batch: pa.RecordBatch, h: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Topic weights of a batch (rows x k), and row, position and weight of its terms."""
    lengths = np.diff(batch.column("_positions").offsets.to_numpy())
    row = np.repeat(np.arange(batch.num_rows), lengths)
    position, weight = (batch.column(c).flatten().to_numpy() for c in ("_positions", "_weights"))
    goal = np.stack([np.bincount(row, weights=weight * t[position], minlength=batch.num_rows) for t in h], axis=1)
    return non_negative(gram, goal, goal / np.maximum(np.diag(gram), _TINY)), row, position, weight


def _sums(terms: DataFrame, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """W^T X (k x vocabulary) and W^T W (k x k): both bounded, so they may reach the driver.

    A task adds up its own texts and hands on one row per column of the two products.
    """
    k, width = h.shape
    table = terms.sparkSession.sparkContext.broadcast(h)

    def work(batches):
        h = table.value
        gram = h @ h.T
        both = np.zeros((k, width + k))
        for batch in batches:
            w, row, position, weight = _texts(batch, h, gram)
            for j in range(k):
                both[j, :width] += np.bincount(position, weights=weight * w[row, j], minlength=width)
            both[:, width:] += w.T @ w
        used = np.flatnonzero(both.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *(pa.array(both[j, used]) for j in range(k))],
            ["position", *(f"s{j}" for j in range(k))],
        )

    found = (
        terms.select("_positions", "_weights")
        .mapInArrow(work, ", ".join(["position long", *(f"s{j} double" for j in range(k))]))
        .groupBy("position")
        .agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)])
        .toArrow()
    )
    both = np.zeros((k, width + k))
    both[:, found.column("position").to_numpy()] = np.stack([found.column(f"s{j}").to_numpy() for j in range(k)])
    return both[:, :width], both[:, width:]


def _weighted(terms: DataFrame, keys: list[str], h: np.ndarray) -> DataFrame:
    """(keys, topics): the weights of all texts for the final topics."""
    table = terms.sparkSession.sparkContext.broadcast(h)
    k = len(h)

    def work(batches):
        h = table.value
        gram = h @ h.T
        for batch in batches:
            w = _texts(batch, h, gram)[0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), lists], [*keys, "topics"])

    schema = ", ".join(f"`{c}` {t}" for c, t in terms.dtypes if c in keys)
    return terms.mapInArrow(work, f"{schema}, topics array<double>")


def nmf(
    vectors: DataFrame, keys: list[str], width: int, k: int = 8, rounds: int = 200, seed: int = 42,
    vector: str = "vector", tolerance: float = 1e-4,
) -> TopicModel:
    """Factorise the non-negative sparse vectors into k topics.

    Topics start from a seeded generator. The squared loss follows from the sums of each round and never
    rises. The fit has converged when the projected gradient falls below ``tolerance`` of that of the first round, or
    the loss stands still; the weights of the texts are optimal for their topics at any time.
    """
    rng = np.random.default_rng(seed)
    raw = F.unwrap_udt(F.col(vector))
    terms = materialize(
        vectors.select(*keys, raw["indices"].alias("_positions"), raw["values"].alias("_weights")), "terms"
    )
    square = F.aggregate("_weights", F.lit(0.0), lambda s, x: s + x * x)
    stats = terms.agg(
        F.sum(square).alias("total"),
        F.sum(F.aggregate("_weights", F.lit(0.0), lambda s, x: s + x)).alias("mass"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    total = stats["total"] or 0.0
    scale = float(np.sqrt(max(stats["mass"] or 0.0, _TINY) / max(stats["n"], 1) / width / k))
    h = scale * (0.5 + rng.random((k, width)))
    losses: list[float] = []
    first, violation, converged = None, 1.0, False
    for _ in range(rounds):
        wtx, wtw = _sums(terms, h)
        losses.append(float(total - 2 * np.sum(wtx * h) + np.sum((wtw @ h) * h)))
        gradient = wtw @ h - wtx
        projected = float(np.abs(np.where(h > 0, gradient, np.minimum(gradient, 0))).sum())
        first = projected if first is None else first
        violation = projected / max(first, _TINY)
        still = len(losses) > 1 and losses[-2] - losses[-1] <= tolerance * 0.01 * abs(losses[-1])
        if violation <= tolerance or still:
            converged = True
            break
        h = non_negative(wtw, wtx.T, h.T).T
    return TopicModel(_weighted(terms, keys, h), h, tuple(losses), converged, violation)


def strongest_topic(texts: DataFrame, topics: str = "topics") -> DataFrame:
    """Adds the topic with the highest weight; ties go to the lowest number."""
    best = F.array_position(topics, F.array_max(topics)).cast("int") - 1
    return texts.withColumn("topic_id", best)


def topic_shares(texts: DataFrame, topics: str = "topics") -> DataFrame:
    """Texts and share per strongest topic."""
    total = texts.agg(F.count(F.lit(1)))
    return (
        strongest_topic(texts, topics)
        .groupBy("topic_id")
        .agg(F.count(F.lit(1)).alias("dominant_inquiries"))
        .withColumn("pct", F.round(F.col("dominant_inquiries") / total.scalar() * 100, 2))
    )


def topic_keywords(model: TopicModel, tfidf: TfidfModel, k: int = 12) -> DataFrame:
    """The k strongest terms of each topic, from the topic table."""
    spark = model.texts.sparkSession
    h = model.topics
    table = spark.createDataFrame(
        [(i, h[:, i].tolist()) for i in range(h.shape[1])], "position int, w array<double>"
    )
    long = table.join(tfidf.terms_table(model.texts), "position").select(
        "term", F.posexplode("w").alias("topic_id", "weight")
    )
    rank = W.partitionBy("topic_id").orderBy(F.desc("weight"), "term")
    return long.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(
        "topic_id", "rank", "term"
    )
