"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the list of the most frequent letter n-grams (1 to 3, words padded with a blank). A
document's own list is compared with each language's by the out-of-place distance: the sum of the differences in rank, with a fixed
penalty for n-grams that a profile lacks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from replyloom.llm.blocks import free_name

#: N-grams of a profile, and learned documents of each language at most (about).
TOP, SAMPLE_DOCS = 400, 4000
#: Characters handled at once; a longer text is counted in pieces.
PIECE = 1_000_000

_GAP = re.compile(r"[\W\d_]+")


def _letters(text: str) -> str:
    """Lower-case words between single blanks; empty if there is no letter."""
    words = _GAP.sub(" ", text).lower()
    return f" {words.strip()} " if any(map(str.isalpha, words)) else ""


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams and their counts. A code holds up to three code points, 21 bits each."""
    code, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for s in range(0, len(text), PIECE):
        x = np.frombuffer(text[s : s + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        own = min(PIECE, len(text) - s)
        blank = x == 32
        two = (x[:-1] << 21) | x[1:]
        three = (two[:-1] << 21) | x[2:]
        parts = [x[:own][~blank[:own]], two[:own], three[:own][~blank[1:-1][:own]]]
        more, n = np.unique(np.concatenate(parts), return_counts=True)
        code, at = np.unique(np.concatenate((code, more)), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate((count, n)), minlength=len(code)).astype(np.int64)
    return code, count


def fit_profiles(
    docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id",
    learn: Column | None = None, sample: int = SAMPLE_DOCS, top: int = TOP,
) -> dict[str, np.ndarray]:
    """Language -> its most frequent n-grams, in order of rank.

    Learns from rows with a language that satisfy ``learn``, at most about ``sample`` of each language, chosen by a hash of id
    and text. Languages are expected to be few (hundreds).
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if learn is None else learn))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy(F.col(lang).alias("lang")).count().collect()}
    if not sizes:
        return {}
    share = F.coalesce(
        *[F.when(F.col(lang) == k, F.lit(min(1.0, sample / n))) for k, n in sorted(sizes.items())]
    )
    place = F.pmod(F.xxhash64(F.col(doc_id), F.length(text)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = rows.where(place < share).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        for batch in batches:
            by: dict[str, list[str]] = {}
            for k, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(k, []).append(_letters(t))
            for k, texts in by.items():
                code, n = _grams("".join(texts))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(code)), pa.array(code), pa.array(n)], ["lang", "gram", "n"])

    grams = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = grams.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    out: dict[str, list[int]] = {}
    for r in ranked.where(F.col("rank") <= top).orderBy("lang", "rank").collect():  # languages x top rows
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", top: int = TOP) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (replaced if present).

    ``lang_pred`` is the language at the least distance, by name among equals, and ``und`` with score 0 if the text is null
    or has no letter, or no language was learned. ``score`` is the share of the language in the soft-max of closeness. Every row is kept.
    """
    names = sorted(profiles)
    known = np.unique(np.concatenate([profiles[k] for k in names])) if names else np.zeros(0, np.int64)
    ranks = np.full((len(known) + 1, len(names)), -1, np.int64)
    for j, k in enumerate(names):
        ranks[np.searchsorted(known, profiles[k]), j] = np.arange(len(profiles[k]))
    shared = docs.sparkSession.sparkContext.broadcast((known, ranks))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def judge(text: str | None, known: np.ndarray, ranks: np.ndarray) -> tuple[str, float]:
        letters = _letters(text) if text else ""
        if not letters or not len(known):
            return "und", 0.0
        code, n = _grams(letters)
        if len(n) > top:  # ties at the cut go by code, as in the full order
            least = np.partition(n, -top)[-top]
            code, n = code[n >= least], n[n >= least]
        own = code[np.lexsort((code, -n))[:top]]
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        at[known[at] != own] = len(known)
        there = ranks[at]
        far = np.where(there < 0, top, np.abs(there - np.arange(len(own))[:, None])).sum(axis=0)
        close = np.exp(-20.0 * (far - far.min()) / (top * len(own)))
        best = int(np.argmin(far))
        return names[best], float(close[best] / close.sum())

    def work(batches):
        known, ranks = shared.value
        for batch in batches:
            found = [judge(t, known, ranks) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*kept, "lang_pred", "score"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    return docs.select(*kept, F.col(text).cast("string").alias(free_name(docs, "_text"))).mapInArrow(
        work, ", ".join([*schema, "lang_pred string", "score double"])
    )
