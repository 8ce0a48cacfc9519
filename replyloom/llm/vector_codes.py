"""Product-quantised codes of vectors; nearest entries by LAESA pivots.

Micó, Oncina and Vidal 1994: distances of every element to a few fixed pivots are computed once. Here the elements are the parts of
the vectors and the pivots some of the first codebook's entries, chosen far apart. In each round only the distances of
the entries to the pivots are new; the largest difference of the two distances of an entry and a part is a lower bound of their own
distance. Entries are visited in the order of that bound and compared exactly, in whole numbers, until the bound
exceeds the best distance found.

Parts and their pivot distances are written once. A round is one map over that table with sums added up inside each task; the
codebooks (entries x dimension whole numbers) are all that the driver sees.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.runtime import materialize

#: Components become whole numbers of 1/1024; larger ones would not leave room for exact distances.
UNIT, LARGEST = 1024.0, 65536.0
#: Pivots of each part, rows of a block, entries that a visit compares at once.
PIVOTS, BLOCK, VISIT = 16, 2048, 8


@dataclass
class Codebooks:
    """Entries of each part (part, entry, component) as whole numbers, and the pivots (part, pivot, component)."""

    entries: np.ndarray
    pivots: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _far_apart(entries: np.ndarray, count: int) -> np.ndarray:
    """Entries of which each is the farthest from those before it, from the first entry on."""
    chosen = [0]
    near = ((entries - entries[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((entries - entries[chosen[-1]]) ** 2).sum(axis=1))
    return entries[chosen]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances (x, y) as float32; a relative error of 1e-6 covers its rounding."""
    out = np.empty((len(x), len(y)), np.float32)
    for j, other in enumerate(y):
        out[:, j] = np.sqrt(((x - other) ** 2).sum(axis=1))
    return out


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of each row (the lower one of equals), squared distance, and exact comparisons made."""
    n = len(x)
    bound = np.zeros((n, len(entries)), np.float32)
    for p in range(to_pivots.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - entry_pivots[None, :, p]), out=bound)
    slack = 1e-6 * (to_pivots.max(axis=1, initial=0).astype(float) + float(entry_pivots.max(initial=0)))
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    best = np.full(n, np.iinfo(np.int64).max)
    index = np.full(n, len(entries))
    open_rows, made = np.arange(n), 0
    for start in range(0, len(entries), VISIT):
        seen = order[open_rows, start : start + VISIT]
        made += seen.size
        squared = ((entries[seen] - x[open_rows, None, :]) ** 2).sum(axis=2)
        least = squared.min(axis=1)
        first = np.where(squared == least[:, None], seen, len(entries)).min(axis=1)
        better = (least < best[open_rows]) | ((least == best[open_rows]) & (first < index[open_rows]))
        rows = open_rows[better]
        best[rows], index[rows] = least[better], first[better]
        if start + VISIT >= len(entries):
            break
        open_rows = open_rows[bound[open_rows, start + VISIT] - slack[open_rows] <= np.sqrt(best[open_rows].astype(float))]
        if not len(open_rows):
            break
    return index, best, made


def _assign(batch: pa.RecordBatch, books: Codebooks, entry_pivots: list[np.ndarray]):
    """Blocks (first row, components, entry of each part, squared distance of each part, exact comparisons)."""
    parts, _, width = books.entries.shape
    x = np.frombuffer(b"".join(batch.column("parts").to_pylist()), np.int32).reshape(batch.num_rows, parts, width)
    d = np.frombuffer(b"".join(batch.column("pivots").to_pylist()), np.float32).reshape(batch.num_rows, parts, books.pivots.shape[1])
    for s in range(0, batch.num_rows, BLOCK):
        block = x[s : s + BLOCK].astype(np.int64)
        found = [nearest(block[:, i], d[s : s + BLOCK, i], books.entries[i], entry_pivots[i]) for i in range(parts)]
        yield s, block, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1), sum(f[2] for f in found)


def _entry_pivots(books: Codebooks) -> list[np.ndarray]:
    return [_distances(e, p) for e, p in zip(books.entries, books.pivots)]


def _finite(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(id, label, x) of the vectors without null and non-finite components."""
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.col(vector).isNotNull() & good).select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), x.alias("x"))


def _seeds(kept: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the least ids as whole numbers; of several vectors of one id the least one."""
    ids = [r["id"] for r in kept.where("id is not null").groupBy("id").agg(F.lit(1)).orderBy("id").limit(entries).collect()]  # at most `entries`
    if not ids:
        ids = [None]
    chosen = kept.where(F.col("id").isin(ids) if ids != [None] else F.col("id").isNull())
    rows = [r["x"] for r in chosen.groupBy("id").agg(F.min("x").alias("x")).orderBy("id").collect()]
    sizes = {len(r) for r in rows}
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
    return np.floor(np.array(rows, float) * UNIT).astype(np.int64).reshape(len(rows), -1)


def compress(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> tuple[DataFrame, Codebooks | None]:
    """Codes of all vectors, and the codebooks.

    Rows whose vector is null or holds a null or non-finite component are left out. Returns (vec_id, label, code, error) for every other
    row: the entry of each part as two hexadecimal digits, and the sum of the squared distances in whole
    numbers of 1/1024. Repeated rows and null ids are coded like others; a repeated id gives one first entry, by its least vector, and
    null ids give one only where there is no other id. With fewer ids than ``entries`` the codebooks are shorter. Other columns are
    dropped. An empty table gives no rows and no codebooks. Vectors of different lengths, lengths that ``parts`` does not
    divide and components of ``LARGEST`` or more raise a ValueError.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry has two hexadecimal digits")
    spark = vectors.sparkSession
    schema = f"vec_id long, label {vectors.schema[label].dataType.simpleString()}, code string, error long"
    kept = _finite(vectors, vec_id, vector, label)
    if not kept.take(1):
        return spark.createDataFrame([], schema), None
    first = _seeds(kept, entries)
    size = first.shape[1]
    if size == 0 or size % parts:
        raise ValueError(f"vectors of length {size} cannot be cut into {parts} parts")
    width = size // parts
    books = first.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    if np.abs(books).max() >= LARGEST * UNIT:
        raise ValueError(f"components of {LARGEST} or more")
    pivots = np.stack([_far_apart(b, PIVOTS) for b in books])
    fixed = spark.sparkContext.broadcast(pivots)  # parts x PIVOTS x width numbers

    def cut(batches):
        own = fixed.value
        for batch in batches:
            column = batch.column("x")
            lengths = np.diff(column.offsets.to_numpy())
            if len(lengths) and (lengths != size).any():
                raise ValueError(f"a vector of length {lengths[lengths != size][0]} beside others of length {size}")
            x = np.floor(column.flatten().to_numpy(zero_copy_only=False) * UNIT)
            if len(x) and np.abs(x).max() >= LARGEST * UNIT:
                raise ValueError(f"components of {LARGEST} or more")
            x = x.astype(np.int64).reshape(-1, parts, width)
            d = np.stack([_distances(x[:, i], own[i]) for i in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("label"), pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary()),
                    pa.array([r.tobytes() for r in d], pa.binary()),
                ],
                ["id", "label", "parts", "pivots"],
            )

    label_type = vectors.schema[label].dataType.simpleString()
    table = materialize(kept.mapInArrow(cut, f"id long, label {label_type}, parts binary, pivots binary"), "codes")
    slim = table.select("parts", "pivots")
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(Codebooks(books, pivots))  # a fixed size

        def add_up(batches):
            own = held.value
            near = _entry_pivots(own)
            total = np.zeros((*own.entries.shape[:2], width + 1), np.int64)
            for batch in batches:
                for _, x, index, _, _ in _assign(batch, own, near):
                    for i in range(parts):
                        np.add.at(total[i], index[:, i], np.pad(x[:, i], ((0, 0), (0, 1)), constant_values=1))
            used = total[:, :, width] > 0
            slot = np.flatnonzero(used.ravel())
            values = total.reshape(-1, width + 1)[slot]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(slot, width + 1), pa.int32()), pa.array(np.tile(np.arange(width + 1), len(slot)), pa.int32()),
                    pa.array(values.ravel(), pa.int64()),
                ],
                ["slot", "place", "total"],
            )

        sums = slim.mapInArrow(add_up, "slot int, place int, total long").groupBy("slot", "place").agg(F.sum("total").alias("total")).toArrow()
        full = np.zeros((books.shape[0] * books.shape[1], width + 1), np.int64)
        full[sums.column("slot").to_numpy(), sums.column("place").to_numpy()] = sums.column("total").to_numpy()
        used = np.flatnonzero(full[:, width])
        moved = books.reshape(-1, width).copy()
        moved[used] = full[used, :width] // full[used, width:]  # rounds down
        books = moved.reshape(books.shape)
    final = Codebooks(books, pivots)
    last = spark.sparkContext.broadcast(final)

    def code(batches):
        own = last.value
        near = _entry_pivots(own)
        for batch in batches:
            codes, errors = [], []
            for _, _, index, squared, _ in _assign(batch, own, near):
                codes.extend(bytes(r).hex() for r in index.astype(np.uint8))
                errors.append(squared.sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *errors]))],
                ["vec_id", "label", "code", "error"],
            )

    return table.mapInArrow(code, schema), final


def compressed_with_label_errors(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): ``label_error`` adds up the errors of equal labels, nulls together."""
    coded, books = compress(vectors, **options)
    coded = materialize(coded, "coded")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_of")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256")
    )
