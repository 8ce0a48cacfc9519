"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.runtime import materialize, salted_join

#: Up to this many edges one task finds the components by itself.
ONE_TASK_EDGES = 1_000_000


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: neighbours of each node move to its least neighbour.

    The large star moves the neighbours above the node, the small star those below it and the node
    itself. The minimum per node is combined before the shuffle and joined back with hot nodes
    salted, so the centre of a giant star is no bottleneck.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    if larger:
        moved = salted_join(both.where(F.col("v") > F.col("u")), least, ["u"], spread=["v"]).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
    else:
        moved = (
            salted_join(both, least, ["u"], spread=["v"])
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
        )
    return moved.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edge table (u, v); a component is named by its
    least node.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond", 2014) need few rounds even for long chains.
    """

    def mark(df: DataFrame) -> tuple:
        row = df.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        return tuple(row)

    current = materialize(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "cc")
    before = None
    while True:
        now = mark(current)
        if now == before or now[0] == 0:
            break
        before = now
        large = materialize(_stars(current, True), "cc")
        current = materialize(_stars(large, False), "cc")
    roots = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node")))
    return (
        roots.distinct()
        .join(current.select(F.col("u").alias("node"), F.col("v").alias("m")), "node", "left")
        .select("node", F.coalesce("m", "node").alias("component"))
    )


def least_members(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node of the component of each, by hooking and halving."""
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        open_edges = root[a] != root[b]
        a, b = a[open_edges], b[open_edges]
    return nodes, nodes[root]


def components_of(edges: DataFrame, most: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component) as ``connected_components``, for edges that are written already.

    Up to ``most`` edges, which are counted, go to one task; more take the rounds of stars.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long"))
    if edges.count() > most:
        return connected_components(edges)

    def solve(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            nodes, root = least_members(table.column("u").to_numpy(), table.column("v").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "component"])

    return edges.repartition(1).mapInArrow(solve, "node long, component long")
