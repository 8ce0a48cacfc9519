"""Density clusters of dense vectors with noise, at one density level.

A point is a core point when enough points, itself included, lie within ``eps``. Core points within
``eps`` of each other share a cluster, everything else is noise. This is what clustering by mutual
reachability gives when it is cut at ``eps``; ``hierarchy.py`` has all levels.

Exact copies are merged into one weighted point first. Points meet through the pivot index of
``metric_index.py``, which compares a point only with cells that may hold a neighbour. A compared
group gives back one row per point (its neighbour count, or an edge of a spanning forest), never
the pairs themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.operators.clusters import NOISE
from replyloom.operators.components import components_of, least_members
from replyloom.operators.metric_index import MetricIndex, build_index, matrix, near_pairs, search, with_pieces
from replyloom.runtime import materialize, running_sums, salted_join


def distinct_points(vectors: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """The vectors (id, v), and each different one with its least id and number of copies."""
    plain = materialize(
        vectors.select(id_col, F.transform(vector, lambda x: x.cast("double")).alias("v")), "vectors"
    )
    points = plain.groupBy("v").agg(
        F.min(id_col).cast("long").alias("pid"), F.count(F.lit(1)).alias("weight")
    )
    return plain, materialize(points, "points")


def _sides(members: pa.Table, sent: pa.Table):
    a, b = matrix(sent.column("v")), matrix(members.column("v"))
    return near_pairs(a, b, sent.column("reach").to_numpy())


def core_points(index: MetricIndex, min_samples: int, eps: float, report: bool = False) -> tuple[DataFrame, int]:
    """Points (pid, v, weight, cell) with at least ``min_samples`` points within eps, itself
    included, and the number of pairs compared (if asked to ``report`` it)."""
    points = with_pieces(index, index.points)
    asked = points.withColumn("reach", F.lit(float(eps)))

    def count(members: pa.Table, sent: pa.Table) -> pa.RecordBatch:
        i, j, _ = _sides(members, sent)
        n = np.bincount(i, weights=members.column("weight").to_numpy()[j], minlength=sent.num_rows)
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays(
            [sent.column("pid").combine_chunks().take(pa.array(some)), pa.array(n[some].astype(np.int64))], ["pid", "n"]
        )

    counts, compared = search(index, points, asked, count, "pid long, n long", ["weight"], None, report)
    dense = counts.groupBy("pid").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples)
    return points.join(dense.select("pid"), "pid", "left_semi"), compared


def near_edges(index: MetricIndex, points: DataFrame, eps: float) -> DataFrame:
    """Edges (u, v) that connect points within eps of each other, as spanning forests of groups."""
    asked = points.withColumn("reach", F.lit(float(eps)))
    m = len(index.pivots)

    def below(batch: pa.RecordBatch) -> np.ndarray:  # each pair of cells meets once
        return np.arange(m)[None, :] <= batch.column("cell").to_numpy()[:, None]

    def connect(members: pa.Table, sent: pa.Table) -> pa.RecordBatch | None:
        i, j, _ = _sides(members, sent)
        u, v = sent.column("pid").to_numpy()[i], members.column("pid").to_numpy()[j]
        if not len(u):
            return None
        nodes, root = least_members(u, v)
        kept = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[kept]), pa.array(root[kept])], ["u", "v"])

    return search(index, points, asked, connect, "u long, v long", [], below)[0]


def numbered_clusters(sizes: DataFrame, component: str = "component") -> DataFrame:
    """(component, label): components numbered from 0 in their order."""
    return running_sums(sizes.select(component), [F.col(component)], {"_n": F.lit(1).cast("long")}).select(
        component, (F.col("_n") - 1).cast("int").alias("label")
    )


def density_cluster(
    vectors: DataFrame,
    min_cluster_size: int = 35,
    min_samples: int = 8,
    eps: float = 0.15,
    id_col: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(id, label): clusters numbered from 0 by their least member, noise and small ones -1."""
    plain, points = distinct_points(vectors, id_col, vector)
    index = build_index(points)
    core, _ = core_points(index, min_samples, eps)
    core = materialize(core, "core")
    edges = materialize(near_edges(index, core, eps), "edges")
    parts = core.select("pid", "weight").join(
        components_of(edges).withColumnRenamed("node", "pid"), "pid", "left"
    ).withColumn("component", F.coalesce("component", "pid"))
    parts = materialize(parts, "parts")
    big = (
        parts.groupBy("component")
        .agg(F.sum("weight").alias("members"))
        .where(F.col("members") >= min_cluster_size)
    )
    # a component may hold most points: its one row is copied to the slices of a salted join
    labels = salted_join(parts, numbered_clusters(big), ["component"], spread=["pid"]).select("pid", "label")
    named = points.join(labels, "pid", "left").select("v", "label")
    return salted_join(plain, named, ["v"], "left", spread=[id_col]).select(
        id_col, F.coalesce("label", F.lit(NOISE)).alias("label")
    )
