"""Density clusters at all levels: spanning tree, condensed tree, excess of mass.

Campello, Moulavi and Sander, "Density-Based Clustering Based on Hierarchical Density Estimates", 2013. The mutual reachability of
two points is the largest of their distance and both core distances (the distance within which ``min_samples``
points lie, the point itself included).

* The minimum spanning tree grows by Borůvka rounds. In a round every component but the largest takes its least edge to
  another one. The lists of nearest neighbours give an upper bound for that edge; only points whose core distance and whose
  last listed neighbour are not above it search the pivot index of ``metric_index.py``, and only in cells that hold
  other components.
* The tree is merged in the order of its edges, some edges at a time. The edges of a pass fall into connected groups, which are
  merged in parallel. What a later pass must know of a component is one row: its size, its cluster, and the sums for the stability
  of that cluster.
* The clusters of the condensed tree are as many as there are splits into two large parts. Which of them count is
  known when a cluster ends; the topmost chosen one above each point is found by pointer doubling.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.operators.clusters import NOISE
from replyloom.operators.components import components_of
from replyloom.operators.density import distinct_points, numbered_clusters
from replyloom.operators.metric_index import MetricIndex, build_index, matrix, near_pairs, rough_distances, search, squares, upper_distances, with_pieces
from replyloom.runtime import materialize, running_sums, salted_join

#: Tree edges that a pass merges; a group of them is held by one task.
PASS_EDGES = 500_000
#: Nearest points that are listed for the rounds of the spanning tree.
NEAR = 8
_SLACK = 1e-6


def _join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join to unique keys. Most rows may share one component; the adaptive skew join splits it."""
    return many.join(one, keys, how)


def _bounded_reach(index: MetricIndex, points: DataFrame, min_samples: int) -> DataFrame:
    """Adds ``reach``: a distance within which ``min_samples`` points surely lie."""
    shared = points.sparkSession.sparkContext.broadcast((index.pivots, index.outer, index.weights))

    def work(batches):
        pivots, outer, weights = shared.value
        for batch in batches:
            far = rough_distances(matrix(batch.column("v")), pivots) + outer
            order = np.argsort(far, axis=1)
            enough = np.cumsum(weights[order], axis=1) >= min_samples
            at = enough.argmax(axis=1)
            bound = np.take_along_axis(far, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]
            bound = np.where(enough.any(axis=1), bound * (1 + _SLACK) + _SLACK, far.max(axis=1, initial=0.0) * 2 + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound)], [*batch.schema.names, "reach"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(work, f"{schema}, reach double")


def _least(members: pa.Table, sent: pa.Table, k: int) -> pa.RecordBatch:
    """The k nearest members of each sent point, as rows (pid, other, w, d)."""
    a, b, reach = matrix(sent.column("v")), matrix(members.column("v")), sent.column("reach").to_numpy()
    i, j, d = near_pairs(a, b, reach, k)  # only what may be among the k nearest is computed exactly
    other = members.column("pid").to_numpy()[j]
    order = np.lexsort((other, d, i))
    i, j, d, other = i[order], j[order], d[order], other[order]
    first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, np.int64)
    place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
    keep = place < k
    return pa.RecordBatch.from_arrays(
        [
            pa.array(sent.column("pid").to_numpy()[i[keep]]), pa.array(other[keep]), pa.array(members.column("weight").to_numpy()[j[keep]]),
            pa.array(d[keep]),
        ],
        ["pid", "other", "w", "d"],
    )


def core_distances(index: MetricIndex, min_samples: int, report: bool = False, listed: int = 0) -> tuple[DataFrame, int]:
    """(pid, core, near) for every point, and the number of pairs compared.

    ``near`` lists the nearest points by distance (other, d), the point itself first, up to ``min_samples`` of them, or
    ``listed`` if that is more. No other point is nearer than the last one.
    """
    points = with_pieces(index, index.points)
    m, k = len(index.pivots), max(1, min_samples, listed)
    asked = _bounded_reach(index, points, k)
    schema = "pid long, other long, w long, d double"

    def own_cell(batch: pa.RecordBatch) -> np.ndarray:
        return np.arange(m)[None, :] == batch.column("cell").to_numpy()[:, None]

    def other_cells(batch: pa.RecordBatch) -> np.ndarray:
        return ~own_cell(batch)

    def work(members: pa.Table, sent: pa.Table) -> pa.RecordBatch:
        return _least(members, sent, k)

    def shortest(found: DataFrame) -> DataFrame:
        """The first entries of each point, with the weight up to each."""
        nearest = F.slice(F.array_sort(F.collect_set(F.struct("d", "other", "w"))), 1, k)
        return found.groupBy("pid").agg(nearest.alias("near"))

    # The own cell first: what it holds bounds the search in the others.
    inside, compared = search(index, points, asked, work, schema, ["weight"], own_cell, report)
    inside = materialize(inside, "near")

    def upto(least: int) -> Column:
        """The weight of the listed points, and the distance within which ``least`` of it lies."""
        return F.aggregate(
            "near", F.struct(F.lit(0).cast("long").alias("w"), F.lit(None).cast("double").alias("d")),
            lambda s, e: F.struct((s["w"] + e["w"]).alias("w"), F.when(s["w"] < least, e["d"]).otherwise(s["d"]).alias("d")),
        )

    bound = shortest(inside).select("pid", upto(k).alias("u")).select("pid", F.when(F.col("u.w") >= k, F.col("u.d")).alias("_own"))
    narrower = asked.join(bound, "pid", "left").withColumn("reach", F.least("reach", F.coalesce("_own", "reach"))).drop("_own")
    outside, more = search(index, points, materialize(narrower, "asked"), work, schema, ["weight"], other_cells, report)
    near = shortest(inside.unionByName(outside)).select("pid", "near", upto(min_samples).alias("u"))
    found = near.select("pid", F.col("u.d").alias("core"), F.transform("near", lambda e: F.struct(e["other"].alias("other"), e["d"].alias("d"))).alias("near"))
    return found, compared + more


def _cell_state(nodes: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """For each cell its component if it holds one only, else -1, and its greatest core distance; and
    whether all points are one component."""
    one, core = np.full(m, -1, np.int64), np.zeros(m)
    found = nodes.groupBy("cell").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.max("core").alias("core")).collect()
    for r in found:  # at most MAX_PIVOTS rows
        one[r["cell"]] = r["a"] if r["a"] == r["b"] else -1
        core[r["cell"]] = r["core"]
    return one, core, len({x for r in found for x in (r["a"], r["b"])}) <= 1


def _round(
    index: MetricIndex, nodes: DataFrame, edges: DataFrame, one: np.ndarray, core: np.ndarray, report: bool, largest: int
) -> tuple[DataFrame, int]:
    """The least edge of every component but the ``largest`` to another one: (comp, w, lo, hi, far), and pairs compared."""
    shared = nodes.sparkSession.sparkContext.broadcast((index.pivots, index.outer, index.members, one, core))
    edge = F.struct("w", "lo", "hi", "far")
    listed = edges.select("cu", F.struct("w", "lo", "hi", F.col("cv").alias("far")).alias("e")).union(
        edges.select("cv", F.struct("w", "lo", "hi", F.col("cu").alias("far")))
    )
    listed = listed.where(F.col("cu") != largest).groupBy(F.col("cu").alias("comp")).agg(F.min("e").alias("e"))

    def foreign(batch: pa.RecordBatch) -> np.ndarray:
        """Cells that hold points of other components."""
        _, _, members, one, _ = shared.value
        return (one[None, :] != batch.column("comp").to_numpy()[:, None]) & (members > 0)

    def bounds(batches):
        pivots, outer, _, _, top = shared.value
        for batch in batches:
            far = rough_distances(matrix(batch.column("v")), pivots) + outer
            far = np.maximum(np.maximum(far, top[None, :]), batch.column("core").to_numpy()[:, None])
            least = np.where(foreign(batch), far, np.inf).min(axis=1, initial=np.inf)
            comps, at = np.unique(batch.column("comp").to_numpy(), return_inverse=True)
            best = np.full(len(comps), np.inf)
            np.minimum.at(best, at, least)
            yield pa.RecordBatch.from_arrays([pa.array(comps), pa.array(best * (1 + _SLACK) + _SLACK)], ["comp", "bound"])

    nodes, members = nodes.where(F.col("comp") != largest), with_pieces(index, nodes)
    limit = nodes.select("comp", "v", "core").mapInArrow(bounds, "comp long, bound double").groupBy("comp").agg(F.min("bound").alias("bound"))
    limit = limit.join(listed, "comp", "left").select("comp", F.least("bound", F.coalesce(F.col("e.w"), "bound")).alias("reach"))
    # what a point has not listed is no nearer than the last one listed
    asked = _join(nodes, limit, ["comp"]).where(F.greatest("core", "radius") <= F.col("reach"))
    asked = asked.select("pid", "v", "core", "comp", "reach")
    if report:  # scanned twice
        asked = materialize(asked, "asked")

    def nearest_other(members: pa.Table, sent: pa.Table) -> pa.RecordBatch | None:
        a, b, reach = matrix(sent.column("v")), matrix(members.column("v")), sent.column("reach").to_numpy()
        (mine, core), (theirs, far_core) = ([t.column(c).to_numpy() for c in ("comp", "core")] for t in (sent, members))
        near, norms, off = squares(a, b)
        some = np.flatnonzero((near.min(axis=1, initial=np.inf) + norms - off <= reach * reach * (1 + 1e-6)) & (far_core.min(initial=np.inf) <= reach))
        if not len(some):
            return None
        a, mine, core, reach, sent = a[some], mine[some], core[some], reach[some], sent.take(pa.array(some))
        # the least edge of a component is not above the least of these bounds, so only pairs up to there are computed exactly
        upper = np.maximum(np.maximum(upper_distances(a, b), core[:, None]), far_core[None, :])
        upper[mine[:, None] == theirs[None, :]] = np.inf
        comps, at = np.unique(mine, return_inverse=True)
        least = np.full(len(comps), np.inf)
        np.minimum.at(least, at, upper.min(axis=1))
        reach = np.minimum(reach, least[at])
        i, j, d = near_pairs(a, b, reach)
        mine, theirs = mine[i], theirs[j]
        w = np.maximum(np.maximum(d, core[i]), far_core[j])
        good = (mine != theirs) & (w <= reach[i])
        if not good.any():
            return None
        i, j, w, mine, theirs = i[good], j[good], w[good], mine[good], theirs[good]
        a, b = sent.column("pid").to_numpy()[i], members.column("pid").to_numpy()[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((hi, lo, w, mine))
        first = order[np.concatenate(([True], mine[order][1:] != mine[order][:-1]))]
        return pa.RecordBatch.from_arrays([pa.array(x[first]) for x in (mine, w, lo, hi, theirs)], ["comp", "w", "lo", "hi", "far"])

    found, compared = search(
        index, members, asked, nearest_other, "comp long, w double, lo long, hi long, far long", ["core", "comp"], foreign, report
    )
    both = found.select("comp", edge.alias("e")).unionByName(listed)
    return both.groupBy("comp").agg(F.min("e").alias("e")).select("comp", "e.*"), compared


def spanning_tree(index: MetricIndex, min_samples: int, report: bool = False) -> tuple[DataFrame, int]:
    """Edges (lo, hi, w) of a minimum spanning tree of mutual reachability, and pairs compared (0 unless
    asked to ``report`` them).

    Edges are ordered by (w, lo, hi), so the tree is the same on any partitioning.
    """
    cores, compared = core_distances(index, min_samples, report, NEAR)
    nodes = index.points.select("pid", "v", "cell").join(cores, "pid").withColumn("comp", F.col("pid"))
    nodes = materialize(nodes.withColumn("radius", F.element_at("near", -1)["d"]), "nodes")
    pairs = nodes.select("pid", "core", F.inline("near")).where("pid <> other")
    other = nodes.select(F.col("pid").alias("other"), F.col("core").alias("_core"))
    edges = _join(pairs, other, ["other"]).select(
        F.greatest("d", "core", "_core").alias("w"), F.least("pid", "other").alias("lo"), F.greatest("pid", "other").alias("hi"),
    ).distinct().select("w", "lo", "hi", F.col("lo").alias("cu"), F.col("hi").alias("cv"))
    edges, nodes = materialize(edges, "edges"), nodes.drop("near")
    tree: list[DataFrame] = []
    while True:
        one, core, done = _cell_state(nodes, len(index.pivots))
        if done:
            break
        # the others reach it, so its own many points need not search
        largest = nodes.groupBy("comp").count().orderBy(F.desc("count"), "comp").first()["comp"]
        best, more = _round(index, nodes, edges, one, core, report, largest)
        best = materialize(best, "best")
        compared += more
        tree.append(best.select("lo", "hi", "w"))
        names = materialize(components_of(best.select(F.col("comp").alias("u"), F.col("far").alias("v"))), "names")
        renamed = names.select(F.col("node").alias("comp"), F.col("component").alias("_new"))
        nodes = materialize(
            _join(nodes, renamed, ["comp"], "left").withColumn("comp", F.coalesce("_new", "comp")).select("pid", "v", "cell", "core", "radius", "comp"),
            "nodes",
        )
        for side in ("cu", "cv"):
            table = names.select(F.col("node").alias(side), F.col("component").alias("_new"))
            edges = _join(edges, table, [side], "left").withColumn(side, F.coalesce("_new", side)).drop("_new")
        edges = materialize(edges.where("cu <> cv"), "edges")
    out = tree[0] if tree else nodes.select(F.col("pid").alias("lo"), F.col("pid").alias("hi"), F.col("core").alias("w")).limit(0)
    for t in tree[1:]:
        out = out.unionByName(t)
    return out.distinct(), compared


#: Rows of a pass. ``part``: what became of component ``id``, now in component ``to``, its loose points in ``cluster``. ``component``:
#: its size, the cluster it is (null: too small), the sum over points of the density at which they left that cluster (``fell``), and
#: the best total stability of clusters ``below``. ``cluster``: one that ended in its parent ``to`` at the distance ``birth``; ``fell`` is its stability.
_ROWS = "kind string, id long, to long, cluster long, size long, birth double, fell double, below double"
_COLUMNS = ["kind", "id", "to", "cluster", "size", "birth", "fell", "below"]


def _merge(edges: pd.DataFrame, parts: pd.DataFrame, least: int) -> pd.DataFrame:
    """Merge the components ``parts`` along tree edges, in the order of their ``rank``."""
    names = parts["comp"].tolist()
    place = {c: i for i, c in enumerate(names)}
    root = list(range(len(names)))
    size, fell, below = parts["size"].tolist(), parts["fell"].tolist(), parts["below"].tolist()
    cluster = [None if pd.isna(c) else int(c) for c in parts["cluster"]]
    loose = [[i] if c is None else [] for i, c in enumerate(cluster)]  # parts whose points are in no cluster yet
    entry: list[int | None] = [None] * len(names)
    ended: list[tuple] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def enter(i: int, to: int) -> None:
        for p in loose[i]:
            entry[p] = to
        loose[i] = []

    edges = edges.sort_values("rank")
    for rank, w, cu, cv in zip(edges["rank"].tolist(), edges["w"].tolist(), edges["cu"].tolist(), edges["cv"].tolist()):
        a, b = find(place[cu]), find(place[cv])
        if cluster[a] is None and cluster[b] is not None:
            a, b = b, a
        level, both = np.inf if w == 0 else 1.0 / w, size[a] + size[b]
        if cluster[b] is not None:  # a split seen from below: both clusters end here, and another one begins
            total = 0.0
            for c in (a, b):
                stability = fell[c] - size[c] * level if np.isfinite(fell[c]) else np.inf
                ended.append(("cluster", cluster[c], 2 * rank, None, size[c], w, stability, below[c]))
                total += max(stability, below[c])
            cluster[a], fell[a], below[a] = 2 * rank, both * level, total
        elif cluster[a] is not None:  # points fall out of the cluster
            fell[a] += size[b] * level
            enter(b, cluster[a])
        elif both >= least:
            cluster[a], fell[a], below[a] = 2 * rank, both * level, 0.0
            enter(a, cluster[a])
            enter(b, cluster[a])
        else:
            loose[a] += loose[b]
            loose[b] = []
        root[b], size[a], names[a] = a, both, min(names[a], names[b])
    roots = [find(i) for i in range(len(root))]
    old = parts["comp"].tolist()
    out = [("part", old[i], names[r], entry[i], None, None, None, None) for i, r in enumerate(roots)]
    out += [("component", names[r], None, cluster[r], size[r], None, fell[r], below[r]) for r in sorted(set(roots))]
    frame = pd.DataFrame(out + ended, columns=_COLUMNS)
    return frame.astype({"to": "Int64", "cluster": "Int64", "size": "Int64"})


def condensed_tree(points: DataFrame, tree: DataFrame, min_cluster_size: int, most: int = PASS_EDGES) -> tuple[DataFrame, DataFrame]:
    """Clusters (id, parent, birth, size, stability, below) and, for each point, the cluster it falls out of (pid, id).

    A cluster has at least ``min_cluster_size`` points. ``birth`` is the distance at which it parts from its parent, ``stability``
    the sum over its points of how much density lies between both ends, ``below`` the best sum of its
    descendants. The root has no parent; with fewer points there are no clusters.
    """
    heavy = running_sums(
        points.where(F.col("weight") >= min_cluster_size).select("pid"), [F.col("pid")], {"_n": F.lit(1).cast("long")}
    ).select("pid", (2 * F.col("_n") + 1).alias("cluster"))
    first = points.select("pid", "weight").join(heavy, "pid", "left")
    parts = materialize(first.select(
        F.col("pid").alias("comp"), F.col("weight").alias("size"), "cluster",
        F.when(F.col("cluster").isNotNull(), F.lit(float("inf"))).otherwise(0.0).alias("fell"), F.lit(0.0).alias("below"),
    ), "parts")
    entered = [first.where("cluster is not null").select("pid", F.col("cluster").alias("id"))]
    loose = first.where("cluster is null").select("pid", F.col("pid").alias("comp"))
    ranked = materialize(
        running_sums(tree, [F.col("w"), F.col("lo"), F.col("hi")], {"rank": F.lit(1).cast("long")}).select(
            "rank", "w", F.col("lo").alias("cu"), F.col("hi").alias("cv")
        ), "tree",
    )
    ended: list[DataFrame] = []
    done, total = 0, ranked.count()

    def merge(edges: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        return _merge(edges, parts, min_cluster_size)

    while done < total:
        done += most
        now, later = ranked.where(F.col("rank") <= done), ranked.where(F.col("rank") > done)
        groups = materialize(components_of(now.select(F.col("cu").alias("u"), F.col("cv").alias("v"))), "groups")
        edges = now.join(groups.select(F.col("node").alias("cu"), F.col("component").alias("g")), "cu")
        held = parts.join(groups.select(F.col("node").alias("comp"), F.col("component").alias("g")), "comp")
        merged = materialize(edges.groupBy("g").cogroup(held.groupBy("g")).applyInPandas(merge, _ROWS), "merged")
        ended.append(merged.where("kind = 'cluster'").select("id", F.col("to").alias("parent"), "birth", "size", F.col("fell").alias("stability"), "below"))
        moved = merged.where("kind = 'part'").select(F.col("id").alias("comp"), "to", F.col("cluster").alias("id"))
        rest = parts.join(groups.select(F.col("node").alias("comp")), "comp", "left_anti")
        parts = materialize(rest.unionByName(
            merged.where("kind = 'component'").select(F.col("id").alias("comp"), "size", "cluster", "fell", "below")
        ), "parts")
        found = materialize(_join(loose, moved, ["comp"], "left"), "loose")
        entered.append(found.where("id is not null").select("pid", "id"))
        loose = found.where("id is null").select("pid", F.coalesce("to", "comp").alias("comp"))
        for side in ("cu", "cv"):
            names = moved.select(F.col("comp").alias(side), "to")
            later = _join(later, names, [side], "left").withColumn(side, F.coalesce("to", side)).drop("to")
        ranked = materialize(later, "tree") if done < total else later
    root = parts.where("cluster is not null").select(
        F.col("cluster").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(float("inf")).alias("birth"), "size",
        F.col("fell").alias("stability"), "below",
    )
    clusters, places = root, entered[0]
    for t in ended:
        clusters = clusters.unionByName(t)
    for t in entered[1:]:
        places = places.unionByName(t)
    return materialize(clusters, "clusters"), places


def _topmost(clusters: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, top): the highest cluster of ``chosen`` (id) that is the cluster itself or above it, by pointer doubling."""
    marked = chosen.select("id", F.col("id").alias("top"))
    step = materialize(clusters.select("id", F.col("parent").alias("up")).join(marked, "id", "left"), "top")
    while step.where("up is not null").limit(1).count():
        above = step.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"))
        step = materialize(
            _join(step, above, ["up"], "left").select("id", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top")), "top"
        )
    return step.select("id", "top")


def _not_below(clusters: DataFrame, chosen: DataFrame, eps: float) -> DataFrame:
    """Clusters of ``chosen`` that part from their parent below ``eps`` are replaced by the first ancestor that does not
    (or by the last one below the root)."""
    parents = clusters.select(F.col("id").alias("parent"), F.col("birth").alias("_birth"), F.col("parent").alias("_above"))
    linked = _join(clusters.where("parent is not null").select("id", "parent", "birth"), parents, ["parent"])
    under_root = F.col("_above").isNull()
    stops = F.when(under_root, F.col("id")).when(F.col("_birth") > eps, F.col("parent"))
    step = materialize(linked.select("id", "birth", stops.alias("target"), F.when(stops.isNull(), F.col("parent")).alias("up")), "climb")
    births = step.select("id", "birth")
    step = step.drop("birth")
    while step.where("target is null").limit(1).count():
        above = step.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("target").alias("_target"))
        step = materialize(
            _join(step, above, ["up"], "left").select("id", F.coalesce("target", "_target").alias("target"), F.col("_up").alias("up")), "climb"
        )
    of = chosen.join(births, "id").join(step, "id")
    return of.select(F.when(F.col("birth") < eps, F.col("target")).otherwise(F.col("id")).alias("id")).distinct()


def chosen_clusters(clusters: DataFrame, eps: float = 0.0) -> DataFrame:
    """(id, top) for every cluster: the chosen cluster that holds it, or null.

    Excess of mass: a cluster is chosen where its stability is at least that of the best choice below it, and nothing
    above it is chosen. The root is never chosen. ``eps`` merges clusters that part below that distance.
    """
    stable = clusters.where(F.col("parent").isNotNull() & (F.col("stability") >= F.col("below"))).select("id")
    top = _topmost(clusters, stable)
    if eps <= 0:
        return top
    picked = materialize(top.where("top is not null").select(F.col("top").alias("id")).distinct(), "picked")
    return _topmost(clusters, _not_below(clusters, picked, eps))


def hierarchical_clusters(
    vectors: DataFrame, min_cluster_size: int = 35, min_samples: int = 8, eps: float = 0.15, id_col: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(id, label): clusters of any density, numbered from 0 by their least member; noise is -1.

    Exact copies are one point of their weight. ``eps`` is the distance below which clusters are not told apart (0 for none).
    """
    plain, points = distinct_points(vectors, id_col, vector)
    index = build_index(points)
    tree, _ = spanning_tree(index, min_samples)
    clusters, places = condensed_tree(points, materialize(tree, "tree"), min_cluster_size)
    top = chosen_clusters(clusters, eps).where("top is not null")
    held = materialize(_join(places, top, ["id"]).select("pid", "top"), "held")
    first = held.groupBy("top").agg(F.min("pid").alias("first"))
    numbers = first.join(numbered_clusters(first, "first"), "first").select("top", "label")
    labels = _join(held, numbers, ["top"]).select("pid", "label")
    named = points.join(labels, "pid", "left").select("v", "label")
    return salted_join(plain, named, ["v"], "left").select(id_col, F.coalesce("label", F.lit(NOISE)).alias("label"))
