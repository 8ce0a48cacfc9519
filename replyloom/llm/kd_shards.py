"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

The table of sizes and coordinates is written once for each level, with the node of every row. A level costs three small
aggregates over it: extent and bytes of each node, a histogram of bytes along the widest dimension, and
a second histogram inside the step where the wanted share of bytes is crossed, along a hash that breaks ties. So a
single source, language or text that holds most bytes is still cut evenly. Leaves reach the target bytes because each node is cut at the
weighted quantile that matches the leaves on either side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.llm.blocks import number_within
from replyloom.runtime import materialize

#: Steps of a histogram.
STEPS = 1024


@dataclass
class _Node:
    """A node of the tree: its leaves, and where it is cut."""

    leaves: int
    dim: str | None = None
    low: float = 0.0
    high: float = 0.0
    step: int = 0
    tie: int = 0


def _crossing(bins: dict[int, int], target: float) -> tuple[int, float]:
    """First step at which the running sum exceeds ``target``, and the sum before it."""
    total = 0
    for step in sorted(bins):
        if total + bins[step] > target:
            return step, total
        total += bins[step]
    return STEPS, total


def _step(dims: list[str]) -> Column:
    """Step of a row along the dimension in which its node is cut."""
    x = F.coalesce(*[F.when(F.col("_dim") == i, F.col(d)) for i, d in enumerate(dims)])
    place = F.floor((x - F.col("_low")) / (F.col("_high") - F.col("_low")) * STEPS)
    return F.when(F.col("_high") > F.col("_low"), F.least(F.lit(STEPS - 1), place)).otherwise(0).cast("int")


def _with_cuts(table: DataFrame, nodes: dict[int, _Node], level: list[int], dims: list[str]) -> DataFrame:
    """Rows of the nodes of a level, with the cut of their node: a row for each node, fewer than there are shards."""
    cuts = [(i, dims.index(nodes[i].dim), nodes[i].low, nodes[i].high, nodes[i].step, nodes[i].tie) for i in level]
    names = ("_node", "_dim", "_low", "_high", "_cut", "_cut_tie")
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(cut, names)]) for cut in cuts])
    held = table.sparkSession.range(1).select(F.inline(rows))
    return table.join(F.broadcast(held), "_node", "left")


def _grow(table: DataFrame, dims: list[str], shards: int) -> tuple[dict[int, _Node], DataFrame]:
    """The tree, and the table with the leaf of every row in ``_node``; a level is written once."""
    nodes = {1: _Node(shards)}
    columns = table.columns
    table = table.withColumn("_node", F.lit(1))
    level = [1] if shards > 1 else []
    extent: dict[str, float] = {}
    while level:
        at = table.where(F.col("_node").isin(level))
        ends = [f(d).alias(f"{n}{d}") for d in dims for n, f in (("low", F.min), ("high", F.max))]
        stats = {r["_node"]: r for r in at.groupBy("_node").agg(F.sum("size").alias("bytes"), *ends).collect()}
        level = [i for i in level if i in stats]  # a node without rows is not cut, but all its leaves exist
        if not level:
            break
        for i in level:
            spread = {d: float(stats[i][f"high{d}"]) - float(stats[i][f"low{d}"]) for d in dims}
            extent = extent or {d: v or 1.0 for d, v in spread.items()}
            dim = max(dims, key=lambda d: spread[d] / extent[d])
            nodes[i].dim, nodes[i].low, nodes[i].high = dim, float(stats[i][f"low{dim}"]), float(stats[i][f"high{dim}"])

        def bins(rows: DataFrame, step: Column) -> dict[int, dict[int, int]]:
            out: dict[int, dict[int, int]] = {i: {} for i in level}
            for r in rows.groupBy("_node", step.alias("step")).agg(F.sum("size").alias("n")).collect():
                out[r["_node"]][r["step"]] = r["n"]  # at most nodes x STEPS rows
            return out

        goal = {}
        for i, found in bins(_with_cuts(at, nodes, level, dims), _step(dims)).items():
            goal[i] = stats[i]["bytes"] * (nodes[i].leaves // 2) / nodes[i].leaves
            nodes[i].step, before = _crossing(found, goal[i])
            goal[i] -= before
        inside = _with_cuts(at, nodes, level, dims).where(_step(dims) == F.col("_cut"))
        for i, found in bins(inside, F.col("_tie")).items():
            tie, before = _crossing(found, goal[i])
            nodes[i].tie = tie + (tie in found and goal[i] - before > found[tie] / 2)
        step = _step(dims)
        right = (step > F.col("_cut")) | ((step == F.col("_cut")) & (F.col("_tie") >= F.col("_cut_tie")))
        child = F.when(F.col("_dim").isNull(), F.col("_node")).otherwise(2 * F.col("_node") + right.cast("int"))
        table = materialize(_with_cuts(table, nodes, level, dims).select(*columns, child.alias("_node")), "level")
        below = []
        for i in level:
            left = nodes[i].leaves // 2
            nodes[2 * i], nodes[2 * i + 1] = _Node(left), _Node(nodes[i].leaves - left)
            below += [j for j in (2 * i, 2 * i + 1) if nodes[j].leaves > 1]
        level = below
    return nodes, table


def kd_shards(
    docs: DataFrame, shards: int = 24, dims: dict[str, Column] | None = None, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 8; shards hold nearly equal sums of it. ``dims`` are numeric
    metadata columns, null as 0; by default the source, the language and the logarithm of the size. ``slot`` numbers the rows of a shard
    from 0 without gaps. Repeated rows and null ids are placed like others. An empty table gives no rows.
    """
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long")
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))

    def named(c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c)), F.lit(1 << 20)) / F.lit(float(1 << 20)) if c in docs.columns else F.lit(0.0)

    dims = dims or {"source": named("source"), "lang": named("lang"), "size": F.log2(size.cast("double"))}
    coordinates = {f"_d{i}": F.coalesce(c.cast("double"), F.lit(0.0)) for i, c in enumerate(dims.values())}
    table = materialize(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"),
            *[c.alias(k) for k, c in coordinates.items()],
            F.monotonically_increasing_id().alias("_row"),  # fixed by the write; tells repeated rows apart
        ).withColumn("_tie", F.pmod(F.xxhash64("doc_id", "text_crc32", "_row"), F.lit(STEPS)).cast("int")),
        "metadata",
    )
    nodes, leaves = _grow(table, list(coordinates), shards)
    first, shard_of = 0, {}
    for i in sorted((i for i in nodes if 2 * i not in nodes), key=lambda i: bin(i)[3:]):
        shard_of[i] = first
        first += nodes[i].leaves
    number = F.element_at(F.create_map(*[F.lit(x) for k, v in shard_of.items() for x in (k, v)]), F.col("_node"))
    placed = leaves.select("doc_id", "size", "text_crc32", "_row", number.cast("int").alias("shard"))
    return number_within(placed, "shard", ["doc_id", "text_crc32", "_row"], "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot"
    )
