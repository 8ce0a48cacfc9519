"""TF-IDF term weights, kept as sparse vectors.

Fitting counts words, then the bigrams of those words that are frequent enough to be in the vocabulary; only these
words and the vocabulary, whose size is a parameter, reach the driver. Transforming is map-only: tasks number the words of
a batch of texts and look them up in the broadcast vocabulary, so no text is ever shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from replyloom.functions.text import bigrams, spaced_words, terms
from replyloom.runtime import materialize


#: Different terms that a task hands on at once.
TERMS = 100_000
#: Words that may occur in bigrams of a vocabulary, as numbers; with more, bigrams are counted as text.
PAIR_WORDS = 1_000_000
#: Texts whose vectors are made at once.
TEXTS = 2048


@dataclass(frozen=True)
class TfidfConfig:
    """Settings of a fit. ``min_df`` counts texts; ``max_df`` is a share of all texts.

    ``stop_words=None`` takes Spark's English list.
    """

    max_features: int = 2500
    use_bigrams: bool = True
    min_df: int = 1
    max_df: float = 1.0
    stop_words: tuple[str, ...] | None = None


CLUSTER_CONFIG = TfidfConfig(5000, True, 3, 0.85)
TOPIC_CONFIG = TfidfConfig(4000, True, 5, 0.6)
RETRIEVAL_CONFIG = TfidfConfig(2500, True, 3)
ESCALATION_CONFIG = TfidfConfig(2500, True, 1)
INTENT_CONFIG = TfidfConfig(1500, True, 1)


def _stop_words(config: TfidfConfig) -> list[str]:
    stop = config.stop_words
    return list(StopWordsRemover.loadDefaultStopWords("english") if stop is None else stop)


def _words(texts: pa.Array, stop: Sequence[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of ``spaced_words`` texts, and the (code, text) of every word left, in order.

    Words are views into the texts, each with the space behind it, until they are different ones.
    """
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or bounds[0] == bounds[-1]:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = pa.py_buffer(texts.buffers()[2]).slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
    space = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    ends = np.concatenate(([0], space + 1))
    coded = pa.LargeStringArray.from_buffers(len(space), pa.py_buffer(ends), data).dictionary_encode()
    words = pc.utf8_slice_codeunits(coded.dictionary, 0, -1)
    keep = pc.greater_equal(pc.utf8_length(words), 2)
    keep = pc.and_(keep, pc.invert(pc.is_in(words, value_set=pa.array(stop, pa.large_string()))))
    code = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(space, bounds - bounds[0])))
    left = keep.to_numpy(zero_copy_only=False)[code]
    return words, code[left], doc[left]


def _counts(term: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different numbers of terms, their occurrences, and the texts (0 to n - 1) with them."""
    key = np.sort(term * n + doc)
    if not len(key):
        return key, key, key
    term = key // n
    first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    new_text = np.concatenate(([True], key[1:] != key[:-1])).astype(np.int64)
    return term[first], np.diff(np.append(first, len(key))), np.add.reduceat(new_text, first)


def _word_statistics(df: DataFrame, text: str, config: TfidfConfig) -> DataFrame:
    """(term, corpus_count, doc_count) of single words."""
    stop = _stop_words(config)

    def count(batches):
        for batch in batches:
            words, code, doc = _words(batch.column("_spaced"), stop)
            term, n, docs = _counts(code, doc, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(term)).cast(pa.string()), pa.array(n), pa.array(docs)], ["term", "corpus_count", "doc_count"]
            )

    return (
        df.select(spaced_words(F.col(text)).alias("_spaced"))
        .mapInArrow(count, "term string, corpus_count long, doc_count long")
        .groupBy("term")
        .agg(F.sum("corpus_count").alias("corpus_count"), F.sum("doc_count").alias("doc_count"))
    )


def _pair_statistics(df: DataFrame, text: str, config: TfidfConfig, words: list[str], least: int) -> DataFrame:
    """(term, corpus_count, doc_count) of the bigrams of ``words`` that occur ``least`` times."""
    stop = _stop_words(config)
    known = df.sparkSession.sparkContext.broadcast(words)  # at most PAIR_WORDS

    def count(batches):
        listed = pa.array(known.value, pa.large_string())
        for batch in batches:
            found, code, doc = _words(batch.column("_spaced"), stop)
            number = pc.fill_null(pc.index_in(found, value_set=listed), -1).to_numpy().astype(np.int64)[code]
            inside = (doc[1:] == doc[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0)
            pair = (number[:-1] * len(listed) + number[1:])[inside]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in _counts(pair, doc[1:][inside], batch.num_rows)], ["pair", "corpus_count", "doc_count"]
            )

    def name(batches):
        listed = pa.array(known.value, pa.string())
        for batch in batches:
            pair = batch.column("pair").to_numpy()
            both = [listed.take(pa.array(x)) for x in (pair // len(listed), pair % len(listed))]
            yield pa.RecordBatch.from_arrays(
                [pc.binary_join_element_wise(*both, " "), *batch.columns[1:]], ["term", "corpus_count", "doc_count"]
            )

    return (
        df.select(spaced_words(F.col(text)).alias("_spaced"))
        .mapInArrow(count, "pair long, corpus_count long, doc_count long")
        .groupBy("pair")
        .agg(F.sum("corpus_count").alias("corpus_count"), F.sum("doc_count").alias("doc_count"))
        .where((F.col("corpus_count") >= least) & (F.col("doc_count") >= config.min_df))
        .mapInArrow(name, "term string, corpus_count long, doc_count long")
    )


def grams(df: DataFrame, text: str, config: TfidfConfig) -> DataFrame:
    """Adds the column ``_grams``: terms without stop words, then the bigrams of what is left."""
    remover = StopWordsRemover(
        inputCol="_terms", outputCol="_kept", stopWords=_stop_words(config), caseSensitive=True
    )
    tokens = df.withColumn("_terms", terms(F.coalesce(F.col(text), F.lit(""))))
    kept = remover.transform(tokens).drop("_terms")
    both = F.concat("_kept", bigrams(F.col("_kept"))) if config.use_bigrams else F.col("_kept")
    return kept.withColumn("_grams", both).drop("_kept")


def term_statistics(df: DataFrame, text: str, config: TfidfConfig) -> DataFrame:
    """(term, corpus_count, doc_count) in one pass.

    A task counts the terms of a batch of texts as numbers, so that what is made for every
    occurrence is a number and only the different terms of a batch go on as text.
    """
    words = grams(df.select(text), text, replace(config, use_bigrams=False)).select("_grams")

    def count(batches):
        for batch in batches:
            for found in _counted(batch.column("_grams"), config.use_bigrams):
                yield found

    return (
        words.mapInArrow(count, "term string, corpus_count long, doc_count long")
        .groupBy("term")
        .agg(F.sum("corpus_count").alias("corpus_count"), F.sum("doc_count").alias("doc_count"))
    )


def _counted(texts: pa.ListArray, use_bigrams: bool) -> Iterator[pa.RecordBatch]:
    """(term, corpus_count, doc_count) of the words of some texts, and of their bigrams."""
    coded = texts.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    n, size = len(texts), len(words)
    doc = np.repeat(np.arange(n), np.diff(texts.offsets.to_numpy()))
    # a word is its code, a bigram both codes above all words; then the text is the last digit
    key = code * n + doc
    if use_bigrams:
        inside = doc[1:] == doc[:-1]
        pair = ((code[:-1] + 1) * size + code[1:])[inside]
        key = np.concatenate((key, pair * n + doc[1:][inside]))
    if not len(key):
        return
    key.sort()
    term = key // n
    first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    new_text = np.concatenate(([True], key[1:] != key[:-1])).astype(np.int64)
    counts = np.diff(np.append(first, len(key)))
    docs, term = np.add.reduceat(new_text, first), term[first]
    alone = int(np.searchsorted(term, size))
    for low, high in ((0, alone), (alone, len(term))):
        for s in range(low, high, TERMS):
            e = min(high, s + TERMS)
            second = words.take(pa.array(term[s:e] % size))
            if low:
                second = pc.binary_join_element_wise(words.take(pa.array(term[s:e] // size - 1)), second, " ")
            yield pa.RecordBatch.from_arrays(
                [second, pa.array(counts[s:e]), pa.array(docs[s:e])], ["term", "corpus_count", "doc_count"]
            )


@dataclass(frozen=True)
class TfidfModel:
    """Vocabulary in the order of its vector positions, with idf weights."""

    vocabulary: tuple[str, ...]
    idf: tuple[float, ...]
    n_docs: int
    config: TfidfConfig

    def transform(self, df: DataFrame, text: str, output: str = "vector") -> DataFrame:
        """Adds the L2-normalised sparse vector of ``text``; all zeros where no term is known."""
        if not self.vocabulary:
            raise ValueError("empty vocabulary")
        size, idf, stop = len(self.vocabulary), np.array(self.idf, np.float64), _stop_words(self.config)
        parts = [t.split(" ") for t in self.vocabulary]
        # numbers of the words that single terms and bigrams consist of
        words = sorted({w for p in parts for w in p})
        number = {w: i for i, w in enumerate(words)}
        single = np.full(len(words) + 1, -1)
        pairs = []
        for position, p in enumerate(parts):
            if len(p) == 1:
                single[number[p[0]]] = position
            elif len(p) == 2 and self.config.use_bigrams:
                pairs.append((number[p[0]] * len(words) + number[p[1]], position))
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)

        def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Number of terms of each text, their positions and weights."""
            found, code, doc = _words(texts, stop)
            listed = pc.index_in(found, value_set=pa.array(words, pa.large_string()))
            number = pc.fill_null(listed, -1).to_numpy().astype(np.int64)[code]
            position = [single[number]]
            docs = [doc]
            if len(pairs):
                inside = (doc[1:] == doc[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0)
                pair = (number[:-1] * len(words) + number[1:])[inside]
                at = np.minimum(np.searchsorted(pairs[:, 0], pair), len(pairs) - 1)
                position.append(np.where(pairs[at, 0] == pair, pairs[at, 1], -1))
                docs.append(doc[1:][inside])
            position, doc = np.concatenate(position), np.concatenate(docs)
            key = np.sort((doc * size + position)[position >= 0])
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            doc, position = key[first] // size, key[first] % size
            weight = np.diff(np.append(first, len(key))) * idf[position]
            norm = np.sqrt(np.bincount(doc, weight * weight, len(texts)))
            return np.bincount(doc, minlength=len(texts)), position, weight / norm[doc]

        @F.arrow_udf(returnType=VectorUDT())
        def vector(texts: pa.Array) -> pa.Array:
            made = [vectors(texts.slice(s, TEXTS)) for s in range(0, len(texts), TEXTS)] or [vectors(texts)]
            n, position, weight = (np.concatenate(x) for x in zip(*made))
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            return pa.StructArray.from_arrays(
                [
                    pa.array(np.zeros(len(n), np.int8)), pa.array(np.full(len(n), size, np.int32)),
                    pa.ListArray.from_arrays(offsets, pa.array(position.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(weight)),
                ],
                ["type", "size", "indices", "values"],
            )

        return df.withColumn(output, vector(spaced_words(F.col(text))))

    def terms_table(self, df: DataFrame) -> DataFrame:
        """(position, term, idf) with one row per vocabulary entry."""
        rows = [(i, t, w) for i, (t, w) in enumerate(zip(self.vocabulary, self.idf))]
        return df.sparkSession.createDataFrame(rows, "position int, term string, idf double")


def tfidf_fit(df: DataFrame, text: str, config: TfidfConfig = RETRIEVAL_CONFIG) -> TfidfModel:
    """Learn vocabulary and smoothed idf: ln((1 + n) / (1 + df)) + 1.

    The vocabulary is cut by corpus frequency, ties by the term itself.
    """
    n_docs = df.count()

    def most(stats: DataFrame) -> list:
        stats = stats.where(F.col("doc_count") >= config.min_df)
        if config.max_df < 1.0:
            stats = stats.where(F.col("doc_count") <= config.max_df * n_docs)
        return stats.orderBy(F.desc("corpus_count"), "term").limit(config.max_features).collect()

    single = materialize(_word_statistics(df, text, config), "words")
    top = most(single)
    if config.use_bigrams and config.max_features > 0:
        # a bigram is no more frequent than its words, and not in the vocabulary below the last of enough words
        least = max(1, top[-1]["corpus_count"] if len(top) == config.max_features else 1)
        frequent = single.where((F.col("doc_count") >= config.min_df) & (F.col("corpus_count") >= least))
        words = [r["term"] for r in frequent.select("term").limit(PAIR_WORDS + 1).collect()]
        if len(words) > PAIR_WORDS:
            top = most(term_statistics(df, text, config))
        else:
            pairs = _pair_statistics(df, text, config, sorted(words), least)
            top = most(pairs.unionByName(df.sparkSession.createDataFrame(top, pairs.schema)))
    top.sort(key=lambda r: r["term"])
    return TfidfModel(
        tuple(r["term"] for r in top),
        tuple(math.log((1 + n_docs) / (1 + r["doc_count"])) + 1 for r in top),
        n_docs,
        config,
    )


def entries(vector: str) -> Column:
    """The non-zero entries of a sparse vector as array<struct<position, weight>>."""
    raw = F.unwrap_udt(F.col(vector))
    return F.zip_with(
        raw["indices"],
        raw["values"],
        lambda i, w: F.struct(i.alias("position"), w.alias("weight")),
    )


def long_weights(vectors: DataFrame, keys: Sequence[str], vector: str = "vector") -> DataFrame:
    """One row per non-zero weight: (keys, position, weight)."""
    return vectors.select(*keys, F.inline(entries(vector)))


def tfidf_weights(model: TfidfModel, df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Long term table (keys, term, weight)."""
    long = long_weights(model.transform(df.select(*keys, text), text), keys)
    # the vocabulary never exceeds max_features rows
    return long.join(F.broadcast(model.terms_table(df)), "position").select(
        *keys, "term", "weight"
    )


def top_terms(
    weights: DataFrame, by: Sequence[str], k: int, members: DataFrame, term: str = "term"
) -> DataFrame:
    """The k terms with the highest mean weight per group; a term absent from a text counts 0.

    ``members`` has (by, members) with the size of each group. Weights are summed per (group, term)
    with a map-side combine before anything is ranked.
    """
    rank = W.partitionBy(*by).orderBy(F.desc("mean_weight"), term)
    return (
        weights.groupBy(*by, term)
        .agg(F.sum("weight").alias("_sum"))
        .join(members, list(by))
        .withColumn("mean_weight", F.round(F.col("_sum") / F.col("members"), 9))
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
        .select(*by, "rank", term, "mean_weight")
    )
