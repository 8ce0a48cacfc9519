"""Exact neighbours of dense vectors through a pivot index.

A sample of the points serves as pivots. Every point lies in the cell of its nearest pivot, and a cell knows the least and the
greatest distance of its members from the pivot. By the triangle inequality a point at distance d from a pivot
can have neighbours within r in that cell only if the ring of the cell, widened by r, contains d. A search compares each
point with all members of the cells it cannot rule out.

Pivots are bounded (``MAX_PIVOTS``), so they and the rings travel by broadcast. Large cells are cut into
pieces. Members, cell by cell, and the points that ask are each written once as blocks; a task reads a pair of
blocks and compares the points with the cells that they reach, so no point is copied to the cells.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.runtime import materialize, met_blocks, written_blocks

#: Most pivots, members of a piece, and points that are compared with one piece at once.
MAX_PIVOTS, PIECE, SENT = 2048, 2000, 100_000
#: Share of the cells of a block that points reach, from which on they are compared with the whole block.
WHOLE = 0.25
#: Points of a written block.
BLOCK = 2000
#: Cells of a matrix of distances that a task holds at a time.
CELLS = 2_000_000
#: Room for the rounding of distances that are computed from squares.
SLACK = 1e-6


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def rough_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by one matrix product; ``SLACK`` of the larger norm covers the lost digits."""
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def upper_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by one matrix product that are surely not too small."""
    return rough_distances(a, b) + 2 * SLACK * (1.0 + np.sqrt(max((a * a).sum(1).max(initial=0.0), (b * b).sum(1).max(initial=0.0))))


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distances by one product in single precision, without the squared norm of the row of ``a`` (given back), and
    how far they are off at most for each row of ``a``."""
    norms, others = (a * a).sum(1), (b * b).sum(1)
    kind = np.float32 if max(norms.max(initial=0.0), others.max(initial=0.0)) < 1e30 else np.float64
    left = np.concatenate((-2.0 * a, np.ones((len(a), 1))), axis=1).astype(kind)
    right = np.concatenate((b, others[:, None]), axis=1).astype(kind)
    off = (a.shape[1] + 8) * 2.0**-22 * (np.sqrt(norms) + np.sqrt(others.max(initial=0.0))) ** 2 + 1e-30
    return left @ right.T, norms, off


def near_pairs(a: np.ndarray, b: np.ndarray, reach: np.ndarray, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of all pairs within ``reach`` of the row of a; with ``k`` at least the k nearest of them.

    A pair has the same distance wherever it is compared: candidates are computed from their differences.
    """
    rows, columns, distances = [], [], []
    step = max(1, CELLS // max(len(b), 1))
    for s in range(0, len(a), step):
        within, most = reach[s : s + step], len(b)
        near, norms, off = squares(a[s : s + step], b)
        limit = within * np.abs(within) + off - norms + 1e-6 * within * within
        inside = near <= limit.astype(near.dtype)[:, None]
        if 0 < k <= most and np.count_nonzero(inside) > 4 * k * len(inside):
            kth = np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * off
            inside = near <= np.minimum(limit, kth).astype(near.dtype)[:, None]
        i, j = np.divmod(np.flatnonzero(inside), max(most, 1))
        i += s
        for t in range(0, len(i), CELLS // 16):
            x, y = i[t : t + CELLS // 16], j[t : t + CELLS // 16]
            d = np.sqrt(((a[x] - b[y]) ** 2).sum(1))
            good = d <= reach[x]
            rows.append(x[good])
            columns.append(y[good])
            distances.append(d[good])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(distances)


@dataclass(frozen=True)
class MetricIndex:
    """``points`` has (pid, weight, v, cell, piece); arrays hold one value for each cell."""

    points: DataFrame
    pivots: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    members: np.ndarray
    weights: np.ndarray

    @property
    def pieces(self) -> np.ndarray:
        return np.maximum(1, -(-self.members // PIECE))

    def reached(self, v: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Which cells (columns) may hold a point within ``reach`` of each row."""
        d = rough_distances(v, self.pivots)
        room = reach[:, None] + SLACK * (1.0 + d)
        return (d - self.outer <= room) & (self.inner - d <= room) & (self.members > 0)


def build_index(points: DataFrame, seed: int = 7, pivots: int | None = None) -> MetricIndex:
    """Index of the points (pid, weight, v); ``pid`` is unique.

    By default there are as many pivots as the root of the number of points, up to ``MAX_PIVOTS``.
    """
    spark = points.sparkSession
    n = points.count()
    m = min(n, MAX_PIVOTS, pivots or int(np.ceil(np.sqrt(n))))
    sample = points.select("v", F.xxhash64("pid", F.lit(seed)).alias("_h"), "pid").orderBy("_h", "pid").limit(m)
    chosen = np.array([r["v"] for r in sample.collect()], float).reshape(m, -1)  # at most MAX_PIVOTS rows
    shared = spark.sparkContext.broadcast(chosen)

    def assign(batches):
        own = shared.value
        for batch in batches:
            d = rough_distances(matrix(batch.column("v")), own)
            cell = d.argmin(axis=1) if d.size else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell] if d.size else np.zeros(0))],
                [*batch.schema.names, "cell", "r"],
            )

    placed = materialize(
        points.select("pid", "weight", "v").mapInArrow(assign, "pid long, weight long, v array<double>, cell int, r double"), "index"
    )
    rings = placed.groupBy("cell").agg(
        F.min("r").alias("inner"), F.max("r").alias("outer"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")
    )
    inner, outer, members, weights = np.zeros(m), np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
    for r in rings.collect():  # at most MAX_PIVOTS rows
        inner[r["cell"]], outer[r["cell"]], members[r["cell"]], weights[r["cell"]] = r["inner"], r["outer"], r["n"], r["w"]
    return MetricIndex(placed, chosen, inner, outer, members, weights)


def _queries(index: MetricIndex, asked: DataFrame, allowed: Callable | None):
    """Function of batches of ``asked`` to (batch, which cells each row goes to)."""
    shared = asked.sparkSession.sparkContext.broadcast((index.pivots, index.inner, index.outer, index.members))

    def cells(batch: pa.RecordBatch) -> np.ndarray:
        pivots, inner, outer, members = shared.value
        own = MetricIndex(None, pivots, inner, outer, members, members)
        hit = own.reached(matrix(batch.column("v")), batch.column("reach").to_numpy(zero_copy_only=False))
        return hit & allowed(batch) if allowed is not None else hit

    return cells


def sent_to_cells(index: MetricIndex, asked: DataFrame, allowed: Callable | None = None) -> np.ndarray:
    """How many of the points (pid, v, reach, ...) go to each cell."""
    cells = _queries(index, asked, allowed)
    m = len(index.pivots)

    def count(batches):
        total = np.zeros(m, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += cells(batch).sum(axis=0)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["cell", "n"])

    out = np.zeros(m, np.int64)
    for r in asked.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def search(
    index: MetricIndex, members: DataFrame, asked: DataFrame, work: Callable[[pa.Table, pa.Table], pa.RecordBatch | None], schema: str,
    columns: list[str], allowed: Callable | None = None, report: bool = False,
) -> tuple[DataFrame, int]:
    """Rows of ``work(members of a piece, points sent to it)``, and the number of pairs compared (0 unless asked to
    ``report`` it).

    A pair may be compared although it is ruled out, but never twice. ``members`` has (pid, v, cell, piece) and ``asked`` (pid, v, reach); both have ``columns`` besides. ``allowed`` may
    rule out further cells (batch of ``asked`` -> matrix of booleans).
    """
    sent = sent_to_cells(index, asked, allowed) if report else np.zeros(len(index.pivots), np.int64)
    shared = asked.sparkSession.sparkContext.broadcast((index.pivots, index.inner, index.outer, index.members))
    extra = ["pid", "v", *columns]
    tasks = asked.sparkSession.sparkContext.defaultParallelism
    home = members.select("cell", "piece", *extra).repartition(tasks, "cell", "piece").sortWithinPartitions("cell", "piece")
    if {"cell", "piece"} <= set(asked.columns):  # cell by cell as well, so that blocks are ruled out as a whole
        asked = asked.repartition(tasks, "cell", "piece").sortWithinPartitions("cell", "piece")
    else:
        asked = asked.repartition(tasks, "pid")

    def compare(held: pa.Table, sent: pa.Table):
        keys = [held.column(c).to_numpy() for c in ("cell", "piece")]
        new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        starts = np.concatenate(([0], np.flatnonzero(new) + 1, [held.num_rows]))
        used = keys[0][starts[:-1]]
        pivots, inner, outer, sizes = (x[used] for x in shared.value)
        own = MetricIndex(None, pivots, inner, outer, sizes, sizes)
        hit = own.reached(matrix(sent.column("v")), sent.column("reach").to_numpy())
        if allowed is not None:
            hit &= allowed(sent)[:, used]
        cells = list(pairwise(starts.tolist()))
        if len(cells) > 1 and hit.mean() >= WHOLE:  # little is ruled out: all cells of the block at once
            cells, hit = [(0, held.num_rows)], hit.any(axis=1, keepdims=True)
        for i, (start, end) in enumerate(cells):
            rows = np.flatnonzero(hit[:, i])
            step = max(1, min(SENT, CELLS // (end - start)))
            for s in range(0, len(rows), step):
                found = work(held.slice(start, end - start), sent.take(pa.array(rows[s : s + step])))
                if found is not None and found.num_rows:
                    yield found

    found = met_blocks(written_blocks(home, "members", BLOCK), written_blocks(asked, "sent", BLOCK), compare, schema)
    return found, int((sent * index.members).sum())


def with_pieces(index: MetricIndex, points: DataFrame) -> DataFrame:
    """``points`` (with ``cell``) and the piece of the cell that each lies in."""
    if (index.pieces == 1).all():
        return points.withColumn("piece", F.lit(0))
    sizes = F.array(*[F.lit(int(x)) for x in index.pieces])
    return points.withColumn("piece", F.pmod(F.xxhash64("pid"), F.element_at(sizes, F.col("cell") + 1)).cast("int"))
