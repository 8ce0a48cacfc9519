"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose measure lies above a cutoff. For every stratum and rule the cutoffs of a fixed grid are
tested from the loosest on, by exact (Clopper-Pearson) binomial bounds of a labelled holdout: a cutoff passes if, with
the confidence asked for, it rejects no more good documents than the rule's share of the allowed rate. The first that fails ends the
sequence, and the last that passed is taken. A fixed sequence needs no correction for its length, so the
confidence is divided by the strata and rules alone (Bonferroni), and all guarantees hold together. A stratum without
enough evidence, or without labels, gets no cutoff and rejects nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.llm.blocks import free_name, texts_of
from replyloom.runtime import bin_index, materialize

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_WHITE = b" \t\n\r\x0b\x0c"
_NOT_SYMBOL = bytes(set(range(256)) - set(SYMBOLS))
_NOT_START = bytes(range(0x80, 0xC0)) + _WHITE


def _measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """(words, characters in words, symbols, lines with a word, repeated lines, repeated words)."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _NOT_START))
    symbols = len(text.translate(None, _NOT_SYMBOL))
    lines = [line for line in text.split(b"\n") if line.strip(_WHITE)]
    repeated = 0
    if n > 2:
        code = {w: i for i, w in enumerate(dict.fromkeys(words))}
        x = np.fromiter(map(code.__getitem__, words), np.int64, n)
        bits = len(code).bit_length()
        if bits <= 21:
            key = (x[:-2] << (2 * bits)) | (x[1:-1] << bits) | x[2:]
        else:
            _, pair = np.unique((x[:-1] << 31) | x[1:], return_inverse=True)
            key = (pair[:-1] << 31) | x[2:]
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[at] > 1)
        if len(twice):
            hit = np.zeros(n, bool)
            for j in range(3):
                hit[twice + j] = True
            repeated = int(hit.sum())
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeated


def document_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the six counts of every whole text (0 for null); columns of
    their names are replaced."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in docs.columns if c != text and c.lower() not in names]

    def work(batches):
        for batch in batches:
            counts = np.array([_measure(t) for t in texts_of(batch.column(batch.num_columns - 1))], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c) for c in counts.T)], [*kept, *names])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    return docs.select(*kept, F.col(text).cast("string").alias(free_name(docs, "_text"))).mapInArrow(
        work, ", ".join([*schema, *(f"{c} long" for c in names)])
    )


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


#: Rule -> its measure; a document is rejected above the cutoff.
RULES = {
    "symbols": lambda: _ratio("n_symbols", "word_chars"),
    "dup_lines": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeat_words": lambda: _ratio("n_repeat_words", "n_words"),
    "long_words": lambda: _ratio("word_chars", "n_words") / 100,
}
#: Cutoffs looked at, from the strictest.
GRID = tuple(round(0.01 * i, 2) for i in (*range(1, 20), *range(20, 100, 4)))


def _log_tail(k: int, n: int, p: float) -> float:
    """Probability of at most k successes of n at rate p."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return 1.0 if k >= n else 0.0
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i])
    logs = logs + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def binomial_upper(k: int, n: int, delta: float) -> float:
    """Exact upper bound of a rate after k of n, with confidence 1 - delta."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if _log_tail(k, n, mid) > delta else (low, mid)
    return high


def surely_below(k: int, n: int, rate: float, delta: float) -> bool:
    """Whether ``binomial_upper(k, n, delta) <= rate`` (``delta`` below a half): at most k of n are that unlikely at this rate."""
    if k >= n * rate:
        return False
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    total, term, j = 1.0, 1.0, k
    while j > 0 and term > 1e-17 * total:  # the terms below fall faster than a geometric series
        term *= j / (n - j + 1) * (1 - rate) / rate
        total += term
        j -= 1
    return log + math.log(total) <= math.log(delta)


def risk_cutoffs(
    measures: DataFrame, labels: DataFrame, stratum: str = "stratum", label: str = "quality", doc_id: str = "doc_id",
    rate: float = 0.05, delta: float = 0.05,
) -> DataFrame:
    """(stratum, cutoffs): for every stratum with a cutoff a map from rule to cutoff.

    ``rate`` is the allowed share of rejected good documents of a stratum over all rules together, ``delta`` the
    probability that any guarantee fails. Rows count whose document is labelled good; one that has both labels is good. Null strata are one
    of their own. Counts by stratum, rule and step of the grid are all that is shuffled; nothing reaches the driver but the
    number of strata.
    """
    good = labels.where((F.col(label) == 1) & F.col(doc_id).isNotNull()).select(doc_id).distinct()
    held = measures.join(good, doc_id, "left_semi")
    steps = [
        F.struct(F.lit(name).alias("rule"), bin_index(measure(), GRID).alias("step")) for name, measure in RULES.items()
    ]
    # bin_index counts cutoffs <= measure; a cutoff rejects what lies strictly above it.
    counts = materialize(
        held.select(F.col(stratum).alias("stratum"), F.explode(F.array(*steps)).alias("s")).groupBy("stratum", "s.rule", "s.step").count(), "steps"
    )
    tests = counts.select("stratum").distinct().count() * len(RULES)
    share, confidence = rate / len(RULES), delta / max(1, tests)

    def strictest(batches):
        for batch in batches:
            found = []
            for entries in batch.column("steps").to_pylist():
                bins = np.zeros(len(GRID) + 1, np.int64)
                for e in entries:
                    bins[e["step"]] += e["count"]
                n = int(bins.sum())
                above = n - np.cumsum(bins)  # at or above the next cutoff: never fewer than are rejected
                cutoff = None
                for i in reversed(range(len(GRID))):
                    if not surely_below(int(above[i]), n, share, confidence):
                        break
                    cutoff = GRID[i]
                found.append(cutoff)
            yield pa.RecordBatch.from_arrays(
                [batch.column("stratum"), batch.column("rule"), pa.array(found, pa.float64())], ["stratum", "rule", "cutoff"]
            )

    kind = measures.schema[stratum].dataType.simpleString()
    listed = counts.groupBy("stratum", "rule").agg(F.collect_list(F.struct("step", "count")).alias("steps"))  # at most a grid each
    cutoffs = listed.mapInArrow(strictest, f"stratum {kind}, rule string, cutoff double").where("cutoff is not null")
    return cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", doc_id: str = "doc_id", **risk: float
) -> DataFrame:
    """(doc_id, stratum, counts, base_failed, rejected_by, kept) of every row of ``docs``.

    ``base_failed``: fewer than 50 words, or over half of them in repeated windows of three words. ``rejected_by``: the first rule above
    its stratum's cutoff, or null. ``kept``: neither. A null text has no words and fails the base; null strata form one of their own. Strata without a cutoff reject nothing. Repeated
    rows are judged each; other columns are dropped.
    """
    slim = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.col(text).alias("text")
    )
    measures = materialize(document_measures(slim), "measures")
    cutoffs = materialize(risk_cutoffs(measures, labels.withColumnRenamed(doc_id, "doc_id"), **risk), "cutoffs").withColumnRenamed("stratum", "_of")
    names = measures.columns
    # Most rows may lie in one stratum: a small table of cutoffs is broadcast by its size, a large one split by the skew join.
    measures = measures.join(cutoffs, F.col("stratum").eqNullSafe(F.col("_of")), "left")
    verdict = F.lit(None).cast("string")
    for rule, measure in reversed(list(RULES.items())):
        verdict = F.when(measure() > F.col("cutoffs")[rule], F.lit(rule)).otherwise(verdict)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures.select(*names, base.alias("base_failed"), verdict.alias("rejected_by")).withColumn(
        "kept", ~F.col("base_failed") & F.col("rejected_by").isNull()
    )
