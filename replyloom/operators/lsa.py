"""Latent semantic analysis: truncated SVD of sparse vectors, without centring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.operators.tfidf import entries
from replyloom.runtime import materialize


@dataclass(frozen=True)
class LsaModel:
    """Right singular vectors (features x k) and singular values, falling.

    ``residuals`` bound the errors: a squared singular value lies within the residual of each.
    ``converged`` tells whether all are below the tolerance.
    """

    components: tuple[tuple[float, ...], ...]
    singular_values: tuple[float, ...]
    residuals: tuple[float, ...] = ()
    converged: bool = False

    def transform(self, vectors: DataFrame, vector: str = "vector", output: str = "lsa"):
        """Adds U * sigma = X * V as an array. Map-only: V has features x k entries, broadcast to the tasks."""
        k = len(self.singular_values)
        table = np.array(self.components).reshape(-1, k)
        shared = vectors.sparkSession.sparkContext.broadcast(table)

        @F.arrow_udf("array<double>")
        def project(positions: pa.Array, weights: pa.Array) -> pa.Array:
            offsets = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(positions), 0).to_numpy())))
            position, weight = positions.flatten().to_numpy(), weights.flatten().to_numpy()
            out = np.zeros((len(positions), k))
            filled = np.flatnonzero(np.diff(offsets))
            row = 0
            while row < len(filled):
                start = offsets[filled[row]]
                end = max(row + 1, int(np.searchsorted(offsets[filled + 1], start + CHUNK_TERMS, "right")))
                rows = filled[row:end]
                t = slice(start, offsets[rows[-1] + 1])
                out[rows] = np.add.reduceat(weight[t][:, None] * shared.value[position[t]], offsets[rows] - start, axis=0)
                row = end
            # a row without a vector has no projection
            ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * k)
            return pa.ListArray.from_arrays(ends, pa.array(out.ravel()), mask=positions.is_null())

        raw = F.unwrap_udt(F.col(vector))
        return vectors.withColumn(output, project(raw["indices"], raw["values"]))


#: Terms multiplied at once inside a task.
CHUNK_TERMS = 50_000
#: Most rows of a dense block.
BLOCK_ROWS = 32


def _gram_product(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """X^T (X Q) in one pass: every task sums its rows into a features x columns matrix, and
    Spark adds up the matrices row by row."""
    width, columns = q.shape
    shared = rows.sparkSession.sparkContext.broadcast(q)  # features x columns

    def partial(batches):
        q = shared.value
        total = np.zeros((width, columns))
        for batch in batches:
            offsets = batch.column("indices").offsets.to_numpy()
            offsets = offsets - offsets[0]
            position, weight = (batch.column(c).flatten().to_numpy() for c in ("indices", "values"))
            offsets = offsets[np.append(True, np.diff(offsets) > 0)]  # rows without terms add nothing
            row = 0
            while row + 1 < len(offsets):
                end = int(np.searchsorted(offsets, offsets[row] + CHUNK_TERMS, "right")) - 1
                end = max(row + 1, min(end, row + BLOCK_ROWS))
                t = slice(offsets[row], offsets[end])
                text = np.repeat(np.arange(end - row), np.diff(offsets[row : end + 1]))
                # few rows are multiplied as a dense block over the features they have
                held, at = np.unique(position[t], return_inverse=True)
                block = np.bincount(text * len(held) + at, weight[t], (end - row) * len(held)).reshape(end - row, -1)
                total[held] += block.T @ (block @ q[held])
                row = end
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *(pa.array(total[used, j]) for j in range(columns))],
            ["position", *(f"z{j}" for j in range(columns))],
        )

    names = [f"z{j}" for j in range(columns)]
    summed = (
        rows.mapInArrow(partial, ", ".join(["position int", *(f"{z} double" for z in names)]))
        .groupBy("position")
        .agg(*[F.sum(z).alias(z) for z in names])
        .toArrow()  # at most one short row per feature
    )
    out = np.zeros((width, columns))
    out[summed.column("position").to_numpy()] = np.stack([summed.column(z).to_numpy() for z in names], axis=1)
    return out


def lsa_fit(
    vectors: DataFrame, width: int, k: int = 64, vector: str = "vector", oversample: int = 10,
    seed: int = 42, tolerance: float = 1e-3, most: int = 16,
) -> LsaModel:
    """Truncated SVD by block Lanczos steps on X^T X with full orthogonalisation.

    Every step is one scan of the sparse vectors; the basis of all steps gives the best approximations so
    far, and the norm of A v - value v bounds their errors. Steps end when all k residuals are below
    ``tolerance`` of the largest value, when the basis spans everything, or after ``most``, which
    ``converged`` tells. The driver holds 2 x width x (k + oversample) x steps numbers, where width is the
    vocabulary size; each task holds width x (k + oversample).
    """
    plain = vectors.schema[vector].dataType.typeName() == "struct"  # (indices, values)
    raw = F.col(vector) if plain else F.unwrap_udt(F.col(vector))
    rows = materialize(
        vectors.select(raw["indices"].alias("indices"), raw["values"].alias("values")), "lsa"
    )
    columns = min(k + oversample, width)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, columns)))[0]
    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    for _ in range(most):
        product = _gram_product(rows, block)
        basis, image = np.hstack([basis, block]), np.hstack([image, product])
        small = basis.T @ image
        values, rotation = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:k]
        values, rotation = values[order], rotation[:, order]
        v = basis @ rotation
        residuals = np.linalg.norm(image @ rotation - v * values, axis=0)
        top = max(float(values.max(initial=0.0)), 1e-300)
        converged = bool((residuals <= tolerance * top).all())
        left = product - basis @ (basis.T @ product)
        left -= basis @ (basis.T @ left)
        q, r = np.linalg.qr(left)
        block = q[:, np.abs(np.diag(r)) > 1e-10 * top][:, : width - basis.shape[1]]
        if converged or not block.shape[1]:
            break
    kept = values > 1e-12 * top
    return LsaModel(
        tuple(tuple(float(x) for x in row) for row in v[:, kept]),
        tuple(float(np.sqrt(x)) for x in values[kept]),
        tuple(float(x) for x in residuals[kept]),
        converged or not block.shape[1],
    )


def explained_variance_ratio(projected: DataFrame, vectors: DataFrame, vector: str = "vector",
                             output: str = "lsa") -> DataFrame:
    """(component, ratio): variance of each component over the total variance of the input."""
    total = (
        vectors.select(F.inline(entries(vector)))
        .groupBy("position")
        .agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q"))
    )
    n = vectors.agg(F.count(F.lit(1))).scalar()
    variance = total.agg(F.sum(F.col("q") / n - F.pow(F.col("s") / n, 2)))
    return (
        projected.select(F.posexplode(output).alias("component", "x"))
        .groupBy("component")
        .agg((F.var_pop("x") / variance.scalar()).alias("ratio"))
    )

