"""Benchmark decontamination by a prefix-filtered set join.

A benchmark window is ``window`` consecutive words of an item (a shorter item is one window). A window
is contained in a document only if all its shingles are, so with the shingles of a window ordered by rarity in the
corpus, the rarest one is a sufficient prefix. The join meets documents and windows on that one shingle only. A
meeting fixes where the window must lie; it is dropped if it would reach over either end of the
document (positional and length bound), and else verified word by word.

Items go through in slices of bounded size, one after the other, each broadcast to the documents. Nothing depends on the number of documents that share a window.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.blocks import WordHashes, chunked, mix, odd, texts_of, windows
from replyloom.runtime import materialize

#: Words: runs of ASCII letters, digits and whatever is not ASCII.
SEPARATORS = bytes(set(range(0x30)) | set(range(0x3A, 0x61)) | set(range(0x7B, 0x80)))
_TO_SPACE = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))
#: Words of a shingle, and words of items in one broadcast slice.
SHINGLE, SLICE_WORDS = 3, 1_000_000
#: Bits of the filter looked up before the sorted shingles.
FILTER_BITS = 1 << 20


def split_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased."""
    return text.lower().translate(_TO_SPACE).split()


class _Slice:
    """The windows of some items, broadcast to every task."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        cache = WordHashes()
        self.items = items
        found: dict[tuple[bytes, ...], set[int]] = {}
        for i, (_, words) in enumerate(items):
            for s in range(max(1, len(words) - window + 1)):
                found.setdefault(tuple(words[s : s + window]), set()).add(i)
        self.windows = list(found)
        self.owners = [sorted(x) for x in found.values()]
        # Every shingle of every window; a window of fewer words than a shingle is met on its first word.
        self.at, self.offset, self.hash, self.width = [], [], [], []
        for k, w in enumerate(self.windows):
            width = SHINGLE if len(w) >= SHINGLE else 1
            hashes, lengths = cache.of([list(w)])
            _, start, value = windows(hashes, lengths, width)
            value = mix(value + np.uint64(width))
            self.at += [k] * len(value)
            self.offset += start.tolist()
            self.hash += value.tolist()
            self.width += [width] * len(value)
        self.at, self.offset, self.width = (np.array(x, np.int64) for x in (self.at, self.offset, self.width))
        self.hash = np.array(self.hash, np.uint64)
        self.keys = np.unique(self.hash)
        self.widths = sorted(set(self.width.tolist()))

    def choose(self, frequency: dict[int, int]) -> None:
        """Keep the rarest shingle of each window as its prefix."""
        often = np.array([frequency.get(int(h), 0) for h in self.hash], np.int64)
        order = np.lexsort((self.offset, self.hash, often, self.at))
        first = order[np.concatenate(([True], self.at[order][1:] != self.at[order][:-1]))] if len(order) else order
        first = first[often[first] > 0]  # a shingle that no document has: nor has any the window
        first = first[np.argsort(self.hash[first], kind="stable")]
        self.at, self.offset, self.hash, self.width = self.at[first], self.offset[first], self.hash[first], self.width[first]
        self.keys = np.unique(self.hash)
        self.widths = sorted(set(self.width.tolist()))

    def filter(self) -> np.ndarray:
        bits = np.zeros(FILTER_BITS, bool)
        bits[(self.keys & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        return bits


def _met(batches, shared):
    """For chunks of documents: (batch, rows, words, met document, start, shingle hash)."""
    cache, part = WordHashes(), shared.value
    bits = part.filter()
    for batch in batches:
        for first, words in chunked(map(split_words, texts_of(batch.column("_text")))):
            hashes, lengths = cache.of(words)
            met = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            for width in part.widths:
                doc, start, value = windows(hashes, lengths, width)
                value = mix(value + np.uint64(width))
                near = np.flatnonzero(bits[(value & np.uint64(FILTER_BITS - 1)).astype(np.int64)])
                place = np.searchsorted(part.keys, value[near])
                near = near[part.keys[np.minimum(place, len(part.keys) - 1)] == value[near]]
                met.append((doc[near], start[near], value[near]))
            yield batch, slice(first, first + len(words)), words, *(np.concatenate(x) for x in zip(*met))


def _frequencies(slim: DataFrame, shared) -> dict[int, int]:
    """Number of documents with each shingle of the slice."""

    def count(batches):
        for _, _, _, doc, _, value in _met(batches, shared):
            if len(doc):
                order = np.lexsort((value, doc))
                d, v = doc[order], value[order]
                new = np.concatenate(([True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])))
                key, n = np.unique(v[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["shingle", "n"])

    rows = slim.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    keys = rows.column("shingle").to_numpy().view(np.uint64)  # at most the shingles of one slice
    return dict(zip(keys.tolist(), rows.column("n").to_pylist()))


def _hits(slim: DataFrame, shared) -> DataFrame:
    """(row columns, n_words, hit positions as runs, items) of every document for one slice."""

    def work(batches):
        part = shared.value
        ends = np.searchsorted(part.hash, part.keys, "right") if len(part.keys) else None
        begins = np.searchsorted(part.hash, part.keys, "left") if len(part.keys) else None
        for batch, rows, words, doc, start, value in _met(batches, shared):
            marks: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[int]] = {}
            place = np.searchsorted(part.keys, value)
            for d, s, k in zip(doc.tolist(), start.tolist(), place.tolist()):
                own = words[d]
                for e in range(begins[k], ends[k]):
                    w = part.at[e]
                    target = part.windows[w]
                    low = s - int(part.offset[e])
                    if low < 0 or low + len(target) > len(own):
                        continue
                    if tuple(own[low : low + len(target)]) == target:
                        marks.setdefault(d, []).append((low, low + len(target)))
                        items.setdefault(d, set()).update(part.owners[w])
            n = len(words)
            spans = [list(chain.from_iterable(_joined(marks[d]))) if d in marks else [] for d in range(n)]
            names = [sorted({part.items[i][0] for i in items[d]}) if d in items else [] for d in range(n)]
            columns = [batch.column(c)[rows] for c in ("_row", "doc_id")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(map(len, words), pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))],
                ["_row", "doc_id", "n_words", "spans", "items"],
            )

    return slim.mapInArrow(work, "_row long, doc_id long, n_words long, spans array<long>, items array<string>")


def _joined(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching stretches as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(set(marks)):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _named(benchmark: DataFrame, text: str, item_id: str) -> DataFrame:
    named = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("_text"))
    return named.where(F.col("item").isNotNull())


def _parts(benchmark: DataFrame, text: str, item_id: str) -> int:
    """Number of slices of about ``SLICE_WORDS`` words."""
    size = _named(benchmark, text, item_id).agg(F.sum(F.length("_text"))).first()[0] or 0
    return int(size // (4 * SLICE_WORDS)) + 1


def _slice(benchmark: DataFrame, text: str, item_id: str, window: int, i: int, parts: int) -> _Slice:
    own = _named(benchmark, text, item_id).where(F.pmod(F.xxhash64("item"), F.lit(parts)) == i).distinct().toArrow()
    found = [(k, split_words(t)) for k, t in zip(own.column("item").to_pylist(), texts_of(own.column("_text")))]
    return _Slice(sorted((k, w) for k, w in found if w), window)


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = 13,
    text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) of every row of ``docs``.

    ``spans`` are [start, end) word positions as a flat list, hit by any window of any item; ``items`` the ids (as
    strings, sorted, distinct) with an occurring window. Null texts have no words; null item ids and items without words match
    nothing; an item id with several texts occurs if one of them does. An empty benchmark gives no hit.
    """
    slim = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text")
    ).withColumn("_row", F.lit(0).cast("long"))
    context = docs.sparkSession.sparkContext
    parts = _parts(benchmark, item_text, item_id)
    if parts == 1:
        return _summed(_hits_of(slim, context, _slice(benchmark, item_text, item_id, window, 0, 1)))
    # Several slices: rows are named by content, so that their results can be put together. A slice is read, used and
    # written before the next one, so the driver holds one at a time.
    slim = slim.withColumn("_row", F.xxhash64("doc_id", "_text"))
    found = reduce(DataFrame.unionByName, (
        materialize(_hits_of(slim, context, _slice(benchmark, item_text, item_id, window, i, parts), i > 0), "slice") for i in range(parts)
    ))
    merged = (
        found.groupBy("_row", "doc_id")
        .agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    )
    copies = slim.groupBy("_row", "doc_id").agg(F.count(F.lit(1)).alias("_copies"))
    whole = merged.join(copies.withColumnRenamed("doc_id", "_id"), "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))

    def join_spans(batches):
        for batch in batches:
            spans = [list(chain.from_iterable(_joined(list(zip(s[::2], s[1::2]))))) for s in batch.column("spans").to_pylist()]
            yield batch.set_column(3, "spans", pa.array(spans, pa.list_(pa.int64())))

    return _summed(whole.select("_row", "doc_id", "n_words", "spans", F.array_sort("items").alias("items")).mapInArrow(
        join_spans, "_row long, doc_id long, n_words long, spans array<long>, items array<string>"
    ))


def _hits_of(slim: DataFrame, context, part: _Slice, hit_only: bool = False) -> DataFrame:
    """Rows of ``_hits`` for a slice; ``hit_only`` leaves out documents without a hit."""
    if len(part.keys):
        draft = context.broadcast(part)
        part.choose(_frequencies(slim, draft))
        draft.unpersist()
    found = _hits(slim, context.broadcast(part))
    return found.where(F.size("spans") > 0) if hit_only else found


def _summed(found: DataFrame) -> DataFrame:
    """Add the number of hit words."""
    n_hit = F.aggregate(
        F.sequence(F.lit(0), F.size("spans")), F.lit(0).cast("long"),
        lambda acc, i: acc + F.when(i >= F.size("spans"), F.lit(0)).when(i % 2 == 1, F.get("spans", i)).otherwise(-F.get("spans", i)),
    )
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.05, **options) -> DataFrame:
    """Rows of ``docs`` without those of which at least ``share`` of the words are hit.

    Rows with a null id are judged by themselves and stay if clean.
    """
    judged = benchmark_hits(docs, benchmark, **options)
    bad = judged.where((F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(share) * F.col("n_words")))
    return docs.join(bad.select("doc_id").distinct(), "doc_id", "left_anti")
