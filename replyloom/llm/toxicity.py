"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

McMahan et al., "Ad Click Prediction: a View from the Trenches", KDD 2013: every coordinate has its own rate, and an
L1 term keeps most weights at exactly zero, so a model is a short list of (slot, weight). Training runs in rounds
over a bounded sample of labelled rows: every task goes through its shard from the shared state, and
the moves of all shards are added slot by slot, damped by the root of their number (iterative
parameter mixing, McDonald et al. 2010).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from replyloom.llm.blocks import WordHashes, chunked, free_name, mix, odd, texts_of
from replyloom.llm.decontam import split_words
from replyloom.runtime import materialize

#: Slots that features are hashed to. Slot 0 is the constant.
SLOTS = 1 << 18
#: Most labelled rows that are learned from.
SAMPLE_ROWS = 24_000
SHARDS, ROUNDS = 4, 8
#: Rows of features that a task takes in at once.
BATCH_ROWS = 256
#: Rows that are scored and handed on at once, and words whose features are made at once.
SCORE_ROWS, FEATURE_WORDS = 1024, 100_000
ALPHA, BETA, L1, L2 = 2.0, 1.0, 5.0, 0.0
#: Value of a pair of words; a word alone counts 1.
PAIR_VALUE = 0.3


def _features(words: list[list[bytes]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of words, pairs of neighbours and pairs that skip one word; with repeats.

    Words take the even slots, pairs the odd ones, so a slot tells its value.
    """
    hashes, lengths = cache.of(words)
    doc = np.repeat(np.arange(len(words)), lengths)
    docs, values = [doc], [hashes]
    for gap in (1, 2):
        same = doc[:-gap] == doc[gap:]
        docs.append(doc[gap:][same])
        values.append((hashes[:-gap] * odd(0) + hashes[gap:] * odd(gap))[same])
    slot = (mix(np.concatenate(values)) % np.uint64(SLOTS // 2 - 1)).astype(np.int64) * 2 + 2
    slot[len(hashes) :] -= 1
    return np.concatenate(docs), slot


def _value(slots: np.ndarray) -> np.ndarray:
    return np.where(slots % 2 == 1, PAIR_VALUE, 1.0)


def _labelled_sample(labels: DataFrame, label: str, doc_id: str, learn: Column, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``rows`` labelled ids and their labels, by a hash of the id."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & learn)
        .groupBy(F.col(doc_id).cast("long").alias("id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    part = known.orderBy(F.xxhash64("id"), "id").limit(rows).toArrow()
    ids, y = part.column("id").to_numpy(), part.column("y").to_numpy()
    order = np.argsort(ids)
    return ids[order], y[order]


def _slots(column: pa.Array) -> Iterator[np.ndarray]:
    """Slots of each row with the constant before them, one row at a time."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    for a, b in pairwise(offsets):
        yield np.append(np.int32(0), np.frombuffer(column.buffers()[2], np.int32, (b - a) // 4, a) if b > a else np.zeros(0, np.int32))


def _step(z: np.ndarray, n: np.ndarray, rows: Iterable[np.ndarray], labels: list[int]) -> None:
    """One pass of FTRL-proximal over the rows, in place."""
    for slots, y in zip(rows, labels):
        zs, ns, value = z[slots], n[slots], _value(slots)
        root = np.sqrt(ns)
        w = np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + root) / ALPHA + L2))
        p = 1.0 / (1.0 + np.exp(-np.clip((w * value).sum(), -30, 30)))
        g = (p - y) * value
        z[slots] = zs + g - (np.sqrt(ns + g * g) - root) / ALPHA * w
        n[slots] = ns + g * g


@contextmanager
def _short_batches(spark: SparkSession):
    """Few rows at a time between files, Spark and Python: a row of features takes as much room as a text."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id",
    learn: Column | None = None, rows: int = SAMPLE_ROWS,
) -> np.ndarray:
    """Weights of the slots, most of them zero (a fixed size of ``SLOTS``).

    Learns from at most ``rows`` labelled rows that satisfy ``learn`` (a condition on ``labels``). Null labels and ids are left out; of
    several labels of an id the largest counts. Without any label all weights are zero.
    """
    spark = docs.sparkSession
    ids, y = _labelled_sample(labels, label, doc_id, F.lit(True) if learn is None else learn, rows)
    known = spark.sparkContext.broadcast((ids, y))  # at most `rows` ids

    def extract(batches):
        ids, y = known.value
        cache = WordHashes()
        for batch in batches:
            column = batch.column("id")
            own = column.fill_null(0).to_numpy()
            place = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
            hit = np.flatnonzero((ids[place] == own) & column.is_valid().to_numpy(zero_copy_only=False)) if len(ids) else np.zeros(0, np.int64)
            texts = texts_of(batch.column("_text").take(pa.array(hit)))
            for first, words in chunked(map(split_words, texts), FEATURE_WORDS):
                doc, slot = _features(words, cache)
                key = np.unique(doc * SLOTS + slot)
                cut = np.searchsorted(key, np.arange(len(words) + 1) * SLOTS)
                rows = [(key[a:b] % SLOTS).astype(np.int32) for a, b in zip(cut[:-1], cut[1:])]
                at = hit[first : first + len(words)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[at]), pa.array(y[place[at]], pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())],
                    ["id", "y", "slots"],
                )

    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("_text"))
    rows_table = slim.mapInArrow(extract, "id long, y int, slots binary")
    dealt = rows_table.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(SHARDS)).cast("int"))
    # The features are made and dealt out once; every round reads them in this order.
    ordered = dealt.repartition(SHARDS, "shard").sortWithinPartitions("shard", F.xxhash64("id"), "id", "slots")
    shards = materialize(ordered.select("shard", "y", "slots"), "toxicity")
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)
    for _ in range(ROUNDS):
        state = spark.sparkContext.broadcast((z.copy(), n.copy()))

        def learn_shard(batches):
            own, z, n = None, None, None

            def moved():
                slot = np.flatnonzero((z != state.value[0]) | (n != state.value[1])).astype(np.int32)
                dz, dn = z[slot] - state.value[0][slot], n[slot] - state.value[1][slot]
                return pa.RecordBatch.from_arrays(
                    [pa.array([own], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (slot, dz, dn))], ["shard", "slot", "z", "n"]
                )

            for batch in batches:
                shard = batch.column("shard").to_numpy()
                for at in np.split(np.arange(len(shard)), np.flatnonzero(shard[1:] != shard[:-1]) + 1):
                    if not len(at):
                        continue
                    if shard[at[0]] != own:
                        if own is not None:
                            yield moved()
                        own, (z, n) = int(shard[at[0]]), (x.copy() for x in state.value)
                    rows = batch.slice(at[0], len(at))
                    _step(z, n, _slots(rows.column("slots")), rows.column("y").to_pylist())
            if own is not None:
                yield moved()

        # A shard gives one row of at most SLOTS slots, whatever the size of the data; they are added up in order.
        with _short_batches(spark):
            moves = shards.mapInArrow(learn_shard, "shard int, slot binary, z binary, n binary").toArrow().to_pylist()
        damp = max(1, len(moves)) ** 0.5
        for move in sorted(moves, key=lambda m: (m["shard"], m["slot"])):
            slot = np.frombuffer(move["slot"], np.int32)
            z[slot] += np.frombuffer(move["z"]) / damp
            n[slot] += np.frombuffer(move["n"]) / damp
        state.unpersist()
    known.unpersist()
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float32)


def score_toxicity(docs: DataFrame, weights: np.ndarray, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the probability of the label in ``column`` (replaced if present).

    The whole text counts. Null and empty texts get the probability of a text without words. Every row is kept.
    """
    slots = np.flatnonzero(weights)
    model = docs.sparkSession.sparkContext.broadcast((slots.astype(np.int32), weights[slots]))
    kept = [c for c in docs.columns if c != column]
    # a text that is kept anyway is not sent a second time
    once = text in kept and docs.schema[text].dataType == StringType()
    at = kept.index(text) if once else len(kept)

    def work(batches):
        w = np.zeros(SLOTS)
        w[model.value[0]] = model.value[1]
        cache = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, SCORE_ROWS):
                part = batch.slice(start, SCORE_ROWS)
                scores = []
                for _, words in chunked(map(split_words, texts_of(part.column(at))), FEATURE_WORDS):
                    doc, slot = _features(words, cache)
                    on = w[slot] != 0
                    key = np.unique(doc[on] * SLOTS + slot[on])
                    total = np.bincount(key // SLOTS, weights=w[key % SLOTS] * _value(key % SLOTS), minlength=len(words)) + w[0]
                    scores.append(1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(np.concatenate(scores))], [*kept, column])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != column), f"`{column}` double"])
    sent = docs.select(*kept) if once else docs.select(*kept, F.col(text).cast("string").alias(free_name(docs, "_text")))
    return sent.mapInArrow(work, schema)
