"""Neighbour index, spanning tree and clusters of any density, against brute force."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from replyloom.operators import density as D
from replyloom.operators import hierarchy as H
from replyloom.operators import metric_index as M
from replyloom.operators.components import components_of


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def reach(x, k):
    """Distinct points with first row and copies, and their mutual reachability."""
    points, where, copies = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    first = np.array([np.flatnonzero(where == i)[0] for i in range(len(points))])
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    core = np.zeros(len(points))
    for i in range(len(points)):
        order = np.argsort(d[i], kind="stable")
        core[i] = d[i][order][np.argmax(np.cumsum(copies[order]) >= k)]
    return where, copies, first, np.maximum(np.maximum(d, core[:, None]), core[None]), core


def tree_of(first, w):
    """Edges in the order (weight, ids) that join two parts."""
    n = len(first)
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    edges = sorted((w[i, j], min(first[i], first[j]), max(first[i], first[j]), i, j) for i in range(n) for j in range(i))
    out = []
    for weight, lo, hi, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            top[a] = b
            out.append((weight, int(lo), int(hi), i, j))
    return out


def brute(x, least, k, eps=0.0):
    where, copies, first, w, _ = reach(x, k)
    n = len(copies)
    kids, height, size, top = {}, {}, {i: int(copies[i]) for i in range(n)}, list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for weight, _, _, i, j in tree_of(first, w):
        a, b = find(i), find(j)
        new = len(top)
        kids[new], height[new], size[new] = (a, b), weight, size[a] + size[b]
        top[a] = top[b] = new
        top.append(new)
    labels = np.full(len(x), -1)
    if size[len(top) - 1] < least:
        return labels
    clusters = []

    def leaves(v):
        out, todo = [], [v]
        while todo:
            u = todo.pop()
            out.extend([u] if u < n else [])
            todo.extend(kids.get(u, ()))
        return out

    def grow(v, birth, parent):
        c = {"birth": birth, "parent": parent, "members": leaves(v), "kids": [], "s": 0.0}
        clusters.append(c)
        number, low = len(clusters) - 1, 0.0 if np.isinf(birth) else 1 / birth
        while True:
            if v < n:
                c["s"] = np.inf
                return number
            level = 1 / height[v]
            large = [u for u in kids[v] if size[u] >= least]
            if len(large) == 1:
                c["s"] += (size[v] - size[large[0]]) * (level - low)
                v = large[0]
                continue
            c["s"] += size[v] * (level - low)
            c["kids"] = [grow(u, height[v], number) for u in large]
            return number

    grow(len(top) - 1, np.inf, None)
    best, chosen = {}, set()
    for c in reversed(range(len(clusters))):
        below = sum(best[q] for q in clusters[c]["kids"])
        if c and clusters[c]["s"] >= below:
            chosen.add(c)
        best[c] = max(clusters[c]["s"], below)

    def highest(chosen):
        out = set()
        for c in chosen:
            above, p = c, clusters[c]["parent"]
            while p is not None:
                above, p = (p if p in chosen else above), clusters[p]["parent"]
            out.add(above)
        return out

    chosen = highest(chosen)
    if eps > 0:
        raised = set()
        for c in chosen:
            if clusters[c]["birth"] < eps:
                while clusters[c]["parent"]:
                    c = clusters[c]["parent"]
                    if clusters[c]["birth"] > eps:
                        break
            raised.add(c)
        chosen = highest(raised)
    for label, (_, c) in enumerate(sorted((min(first[clusters[c]["members"]]), c) for c in chosen)):
        labels[np.isin(where, clusters[c]["members"])] = label
    return labels


def two_densities(seed=1):
    rng = np.random.default_rng(seed)
    tight = [rng.normal(c, 0.05, (60, 2)) for c in ((0, 0), (0.3, 0.3))]
    x = np.concatenate([*tight, rng.normal(4, 0.7, (80, 2)), rng.uniform(-4, 8, (30, 2))]).round(3)
    return np.concatenate([x, x[:15]])


def test_two_densities(spark, monkeypatch):
    """No single radius finds the two tight groups and the wide one; the hierarchy does."""
    x = two_densities()
    monkeypatch.setattr(H, "PASS_EDGES", 40)  # several passes
    got = dict(map(tuple, H.hierarchical_clusters(frame(spark, x), 12, 5, 0.0).collect()))
    want = brute(x, 12, 5)
    assert [got[i] for i in range(len(x))] == want.tolist() and want.max() == 2
    tight, wide = want[:60], want[120:200]
    assert len(set(tight[tight >= 0])) == 1 and len(set(want[60:120][want[60:120] >= 0])) == 1 and (wide == wide.max()).mean() > 0.8
    where, _, _, w, core = reach(x, 5)

    def cut(eps):
        """Clusters at one level: rows of the three groups in clusters of their own."""
        near = (w <= eps) & (core <= eps)[:, None] & (core <= eps)[None]
        part = np.arange(len(w))
        for _ in range(len(w)):
            part = np.where(near, part[None], len(w)).min(1, initial=len(w))
            part = np.where(core <= eps, np.minimum(part, np.arange(len(w))), np.arange(len(w)))
        rows = part[where]
        groups = [np.bincount(rows[a:b]).argmax() for a, b in ((0, 60), (60, 120), (120, 200))]
        return len(set(groups)) == 3 and (rows[120:200] == groups[2]).mean() > 0.8

    assert not any(cut(e) for e in np.geomspace(0.02, 2, 25))


@pytest.mark.parametrize("least,k,eps", [(6, 3, 0.3), (20, 1, 0.0)])
def test_hierarchy_equals_brute_force(spark, least, k, eps):
    x = two_densities(2)[::2]
    got = dict(map(tuple, H.hierarchical_clusters(frame(spark, x), least, k, eps).collect()))
    assert [got[i] for i in range(len(x))] == brute(x, least, k, eps).tolist()


def test_few_points(spark):
    x = np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 0.0]])
    for rows in (x, x[:1], x[:2]):
        got = dict(map(tuple, H.hierarchical_clusters(frame(spark, rows), 4, 2, 0.0).collect()))
        assert got == dict.fromkeys(range(len(rows)), -1)


def test_merge_of_heavy_points(spark):
    """Copies alone can be a cluster."""
    x = np.array([[0.0, 0.0]] * 6 + [[5.0, 0.0]] * 6 + [[2.0, 0.0], [2.1, 0.0]])
    got = dict(map(tuple, H.hierarchical_clusters(frame(spark, x), 5, 2, 0.0).collect()))
    assert [got[i] for i in range(len(x))] == brute(x, 5, 2).tolist()


def test_spanning_tree_and_core_distances(spark, monkeypatch):
    monkeypatch.setattr(M, "PIECE", 7)
    monkeypatch.setattr(M, "SENT", 11)
    x = two_densities(3)[::2]
    _, points = D.distinct_points(frame(spark, x), "vec_id", "embedding")
    index = M.build_index(points)
    where, _, first, w, core = reach(x, 4)
    got = {r["pid"]: r["core"] for r in H.core_distances(index, 4)[0].collect()}
    assert got == pytest.approx({int(f): c for f, c in zip(first, core)})
    tree, compared = H.spanning_tree(index, 4, report=True)
    assert sorted((r["lo"], r["hi"], round(r["w"], 9)) for r in tree.collect()) == sorted((lo, hi, round(v, 9)) for v, lo, hi, _, _ in tree_of(first, w))
    assert compared > 0


def test_index_prunes_and_loses_nothing(spark):
    rng = np.random.default_rng(4)
    centres = rng.uniform(-50, 50, (40, 8))
    x = (centres[rng.integers(0, 40, 3000)] + rng.normal(0, 0.3, (3000, 8))).round(4)
    _, points = D.distinct_points(frame(spark, x), "vec_id", "embedding")
    index = M.build_index(points)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core, compared = D.core_points(index, 6, 0.7, report=True)
    assert {r["pid"] for r in core.collect()} == set(np.flatnonzero((d <= 0.7).sum(1) >= 6).tolist())
    assert compared < len(x) ** 2 / 10


@pytest.mark.parametrize("most", [0, 100])
def test_components_in_one_task_or_by_stars(spark, most):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 9)] + [(7, 7)]
    got = components_of(spark.createDataFrame(edges, "u long, v long"), most).collect()
    want = {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(9)}}
    assert {r["node"]: r["component"] for r in got} == want


def test_search_copies_no_point_to_the_cells(spark, monkeypatch):
    """Asked points of all cells, in blocks of a few, against brute force; only the members are dealt out, once."""
    monkeypatch.setattr(M, "PIECE", 5)
    monkeypatch.setattr(M, "BLOCK", 7)
    met = []
    meet = M.met_blocks
    monkeypatch.setattr(M, "met_blocks", lambda *a: met.append(meet(*a)) or met[-1])
    v = np.random.default_rng(9).normal(size=(60, 3))
    points = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(v)], "pid long, weight long, v array<double>")
    index = M.build_index(points, pivots=6)
    members = M.with_pieces(index, index.points)

    def near(members, sent):
        i, j, _ = M.near_pairs(M.matrix(sent.column("v")), M.matrix(members.column("v")), sent.column("reach").to_numpy())
        a, b = sent.column("pid").to_numpy()[i], members.column("pid").to_numpy()[j]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    found, _ = M.search(index, members, members.selectExpr("*", "1.0D AS reach"), near, "a long, b long", [])
    got = [(r["a"], r["b"]) for r in found.collect()]
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    assert len(got) == len(set(got)) and set(got) == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 1.0))}
    plan = met[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Sort" not in plan


def test_least_edges_compute_few_pairs_exactly(spark, monkeypatch):
    """Vectors far apart: nearly all pairs lie within the first bounds, few may be a least edge."""
    x = np.random.default_rng(4).normal(size=(40, 32))
    assert (M.upper_distances(x, x) >= np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))).all()
    table = pa.table({"pid": np.arange(40), "weight": np.ones(40, np.int64), "v": x.tolist(), "reach": np.full(40, 99.0)})
    computed = []
    monkeypatch.setattr(H, "near_pairs", lambda *a: computed.append(M.near_pairs(*a)) or computed[-1])
    found = H._least(table, table, 2).to_pandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert len(computed[0][0]) <= 100
    for i in range(40):
        assert found[found.pid == i].other.tolist() == np.argsort(d[i], kind="stable")[:2].tolist()


def test_nearest_pairs_are_chosen_before_they_are_computed():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(50, 16)) + 3, rng.normal(size=(80, 16)) + 3
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    near, norms, off = M.squares(a, b)
    assert (np.abs(near + norms[:, None] - d**2) <= off[:, None]).all()
    i, j, w = M.near_pairs(a, b, np.full(50, 4.0))
    assert set(zip(i.tolist(), j.tolist())) == {(int(x), int(y)) for x, y in zip(*np.nonzero(d <= 4.0))}
    i, j, w = M.near_pairs(a, b, np.full(50, 99.0), 3)
    assert len(i) <= 50 * 4
    for r in range(50):
        assert set(np.argsort(d[r])[:3].tolist()) <= set(j[i == r].tolist())
    np.testing.assert_array_equal(w, np.sqrt(((a[i] - b[j]) ** 2).sum(1)))


def test_largest_component_does_not_search(spark, monkeypatch):
    """Every other component reaches it, so the many points of the largest one are never sent out."""
    x = two_densities(5)[::4]
    _, points = D.distinct_points(frame(spark, x), "vec_id", "embedding")
    index = M.build_index(points)
    rounds, search = [], H.search

    def seen(index, members, asked, *rest):
        if "comp" in asked.columns:
            rounds.append((Counter(r["comp"] for r in members.collect()), {r["comp"] for r in asked.collect()}))
        return search(index, members, asked, *rest)

    monkeypatch.setattr(H, "search", seen)
    _, _, first, w, _ = reach(x, 3)
    tree, _ = H.spanning_tree(index, 3)
    got = sorted((r["lo"], r["hi"], round(r["w"], 9)) for r in tree.collect())
    assert got == sorted((lo, hi, round(v, 9)) for v, lo, hi, _, _ in tree_of(first, w))
    for held, asking in rounds:
        assert min(c for c, n in held.items() if n == max(held.values())) not in asking
