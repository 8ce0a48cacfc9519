"""Small numpy and Arrow helpers that run inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words handled at once inside a task; bounds the arrays of one step.
CHUNK_WORDS = 400_000
#: Distinct words a task remembers before it forgets them all.
CACHE_WORDS = 200_000

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finalizer of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def odd(i: int) -> np.uint64:
    """The i-th of a row of odd 64-bit multipliers."""
    return np.uint64(((i + 1) * _GOLD | 1) & 0xFFFFFFFFFFFFFFFF)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered up to ``CACHE_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the number of words of each list."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        total = int(lengths.sum())
        return np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.uint64, total), lengths


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunked(words: Iterator[list[bytes]], limit: int = CHUNK_WORDS) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Runs of documents of about ``limit`` words, each with the index of its first document."""
    first, held, size = 0, [], 0
    for i, w in enumerate(words):
        if held and size + len(w) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(w)
        size += len(w)
    if held:
        yield first, held


def windows(hashes: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start in the document, hash) of every ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for j in range(width):
        value += hashes[j : j + n] * odd(j)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    keep = doc[:n] == doc[width - 1 :]
    doc = doc[:n][keep]
    return doc, np.flatnonzero(keep) - first[doc], mix(value[keep])


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``work`` to each Arrow batch."""

    def each(batches):
        for batch in batches:
            out = work(batch)
            if out.num_rows:
                yield out

    return df.mapInArrow(each, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_slices(df: DataFrame) -> int:
    """Number of slices a hot group is cut into: follows the session's shuffle partitions."""
    return max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def number_within(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Gapless numbers from 0 within ``group``, without bringing a group into one task.

    A group is cut into slices by a hash; rows are numbered inside their slice and the sizes of the
    slices before are added. Slices of a group are as many as shuffle partitions, so their table
    stays small beside the rows.
    """
    from pyspark.sql import Window as W

    n = spread_slices(df)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    sizes = sliced.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(group).alias("_group"), F.col("_slice").alias("_of"),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
    )
    inside = W.partitionBy(group, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_n", F.row_number().over(inside) - 1)
        .join(offsets, (F.col(group) == F.col("_group")) & (F.col("_slice") == F.col("_of")))
        .withColumn(out, (F.col("_n") + F.col("_before")).cast("long"))
        .drop("_slice", "_n", "_group", "_of", "_before")
    )
