import random

import pytest
from pyspark.sql import functions as F

from replyloom import runtime
from replyloom.operators import graph as G
from replyloom.operators import posts as P
from replyloom.operators import profile as B
from replyloom.operators import threads as T

POST = ("tweet_id long, author_id string, inbound boolean, created_at timestamp, text string, "
        "in_reply_to long")


def posts(spark, rows):
    return spark.createDataFrame(rows, POST)


def chain(*edges):
    return [(i, "u", True, None, f"t{i}", p) for i, p in edges]


def brute_paths(edges):
    parent = dict(edges)
    children = {}
    for i, p in edges:
        if p in parent:
            children.setdefault(p, []).append(i)
    found = []

    def walk(path):
        below = children.get(path[-1], [])
        if not below:
            found.append(tuple(path))
        for c in below:
            walk(path + [c])

    for i, p in edges:
        if p is None or p not in parent:
            walk([i])
    return sorted(found)


def spark_paths(df):
    rows = G.path_members(df).collect()
    paths = {}
    for r in rows:
        paths.setdefault((r["root_id"], r["leaf_id"]), {})[r["position"]] = r["tweet_id"]
        assert r["depth"] > r["position"] >= 0
    out = []
    for (root, leaf), members in paths.items():
        path = tuple(members[i] for i in range(len(members)))
        assert path[0] == root and path[-1] == leaf
        out.append(path)
    assert len(rows) == sum(map(len, out))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(i, rng.choice([None, 999, *range(max(0, i - 6), i)])) for i in range(1, 60)]
    edges += [(100, 101), (101, 102), (102, 100), (103, 100)]  # a cycle and a post below it
    df = posts(spark, chain(*edges))
    assert spark_paths(df) == brute_paths(edges)


def test_deep_chain_and_partitioning(spark):
    edges = [(i, i - 1 if i > 1 else None) for i in range(1, 71)]
    for n in (1, 7):
        df = posts(spark, chain(*edges)).repartition(n)
        assert spark_paths(df) == [tuple(range(1, 71))]


def test_hot_parent_is_salted(spark, monkeypatch):
    monkeypatch.setattr(runtime, "COOL_ROWS", 5)
    monkeypatch.setattr(runtime, "HOT_SHARE", 10)
    edges = [(1, None)] + [(i, 1) for i in range(2, 60)] + [(100 + i, i) for i in range(2, 30)]
    df = posts(spark, chain(*edges))
    assert spark_paths(df) == brute_paths(edges)
    assert G.reply_edges(df).count() == len(edges) - 1
    assert [r["tweet_id"] for r in G.thread_roots(df).collect()] == [1]


def test_closure_stops_after_three_hops(spark):
    df = posts(spark, chain((1, None), (2, 1), (3, 2), (4, 3), (5, 4)))
    got = G.ancestor_closure(df, df.where("tweet_id = 5"), 3)
    assert sorted(r["tweet_id"] for r in got.collect()) == [2, 3, 4, 5]


def test_depth_stats_median(spark):
    leaves = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("a", 9), ("b", 3)], "g string, depth long")
    got = {r["g"]: r for r in G.depth_stats(leaves, ["g"]).collect()}
    assert got["a"]["median_depth"] == 3.0 and got["a"]["pct_depth_ge_3"] == 50.0
    assert got["b"]["median_depth"] == 3.0 and got["b"]["max_depth"] == 3


def conversation(spark):
    rows = [
        (1, "77", True, "2017-10-11 06:00:00", "@Delta my bag is lost, call 404 555 1234", None),
        (2, "Delta", False, "2017-10-11 07:30:00", "Please DM us your confirmation *AB", 1),
        (3, "77", True, "2017-10-12 09:00:00", "Thanks, sent!", 2),
        (4, "Delta", False, "2017-10-12 09:15:00", "All set, bag found. ^CD", 3),
        (5, "Delta", False, None, "We appreciate your patience *EF", 1),
        (6, "99", True, "2017-10-11 08:00:00", "nobody answers", None),
    ]
    from datetime import datetime

    return posts(
        spark,
        [(i, a, b, t and datetime.fromisoformat(t + "+00:00"), x, p) for i, a, b, t, x, p in rows],
    )


def test_threads(spark):
    got = {r["leaf_tweet_id"]: r for r in T.reconstruct_threads(conversation(spark)).collect()}
    assert set(got) == {4, 5}
    long, short = got[4], got[5]
    assert long["thread_id"] == short["thread_id"] == "delta_thread_1"
    assert long["customer_inquiry_text"] == "@Delta my bag is lost, call <PHONE_NUMBER>"
    assert long["initial_brand_reply"] == "Please DM us your confirmation"
    assert [t["gap_from_prev_hours"] for t in long["turns"]] == [0.0, 1.5, 25.5, 0.25]
    assert long["metadata"]["agent_signatures"] == ["*AB", "^CD"]
    flags = long["metadata"]["flags"]
    assert flags["multi_agent_handoff"] and flags["temporal_gap_gt_24h"]
    assert not flags["is_pure_canned_deflection"]
    flags = short["metadata"]["flags"]
    assert flags["is_pure_canned_deflection"] and not flags["temporal_gap_gt_24h"]


def test_flags_without_arrays_agree_with_threads(spark):
    df = conversation(spark)
    folded = {r["leaf_tweet_id"]: r for r in T.thread_flags(df).collect()}
    for r in T.reconstruct_threads(df).collect():
        f = folded.pop(r["leaf_tweet_id"])
        assert f["num_turns"] == r["num_turns"]
        for name in ("multi_agent_handoff", "temporal_gap_gt_24h", "is_pure_canned_deflection"):
            assert f[name] == r["metadata"]["flags"][name]
    assert not folded
    summary = T.cleaning_summary(df).first()
    assert summary["total_threads"] == 2 and summary["branching_threads"] == 1
    assert summary["phones"] == 2 and summary["multi_agent_handoffs"] == 1


def test_profile_of_an_absent_brand_is_zero(spark):
    got = {r["brand"]: r for r in B.profile_brands(conversation(spark), ["Delta", "Nobody"]).collect()}
    assert got["Delta"]["outbound_replies"] == 3
    assert got["Delta"]["reconstructed_threads"] == 2
    assert got["Delta"]["max_thread_depth"] == 4
    assert all(v == 0 for k, v in got["Nobody"].asDict().items() if k != "brand")


def test_last_duplicate_wins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")], "tweet_id long, o int, text string")
    got = sorted((r["tweet_id"], r["text"]) for r in P.dedupe_posts(df, "o").collect())
    assert got == [(1, "c"), (2, "z")]


def test_running_sums_span_partitions(spark):
    df = spark.range(0, 1000).withColumn("g", F.col("id") % 3)
    got = runtime.running_sums(df, [F.col("id")], {"s": F.col("id")}, by=["g"], partitions=7)
    for r in got.collect():
        assert r["s"] == sum(range(r["g"], r["id"] + 1, 3))


def test_repeated_posts_count_once(spark):
    df = conversation(spark)
    twice = df.unionByName(df.where("tweet_id in (2, 3)"))
    want = {r["leaf_tweet_id"]: r for r in T.reconstruct_threads(df).collect()}
    got = {r["leaf_tweet_id"]: r for r in T.reconstruct_threads(twice.repartition(3)).collect()}
    assert got == want
    flags = sorted(T.thread_flags(df).collect(), key=str)
    assert sorted(T.thread_flags(twice).collect(), key=str) == flags
    assert P.brand_corpus(twice, ["Delta"]).count() == P.brand_corpus(df, ["Delta"]).count()


@pytest.mark.parametrize("scoped", [True])
def test_contraction_equals_following(spark, monkeypatch, scoped):
    """Rounds of contraction give what one task gives; a round reads fewer rows than the one before."""
    rng = random.Random(6)
    edges = [(i, i - 1 if rng.random() < 0.8 else rng.choice([None, rng.randrange(i), 999])) for i in range(1, 160)] + [(0, None)]
    edges += [(200, 201), (201, 202), (202, 200), (203, 202), (204, 204)]  # cycles and what hangs on them
    rows = [(f"b{k}", i, p, f"s{i * 7 % 5}" if i % 3 else None, i % 4 if i % 5 else None) for k in range(2) for i, p in edges]
    df = spark.createDataFrame(rows, "brand string, tweet_id long, in_reply_to long, sig string, n long")
    df, scope = (df, ["brand"]) if scoped else (df.where("brand = 'b0'"), [])
    measures = {"low": (F.col("sig"), "min"), "high": (F.col("sig"), "max"), "total": (F.col("n"), "sum"), "own": (F.col("n"), "own")}
    columns = [*scope, "tweet_id", "root_id", "depth", "low", "high", "total", "own"]

    def found():
        folded = G.fold_ancestors(df, scope, measures)
        return sorted(map(tuple, folded.nodes.select(*columns).collect()), key=repr), sorted(r["leaf_id"] for r in folded.leaves.collect())

    one = found()
    parent = dict(edges)

    def path(i):
        out = [i]
        while parent.get(out[-1]) in parent:
            out.append(parent[out[-1]])
            if len(out) > len(parent):
                return None
        return out

    by = {(k, i): (sig, n) for k, i, _, sig, n in rows}
    want = []
    for k in ["b0", "b1"] if scoped else ["b0"]:
        for i in parent:
            if (p := path(i)) is not None:
                sigs = [by[k, x][0] for x in p if by[k, x][0] is not None]
                numbers = [by[k, x][1] for x in p]
                total = sum(x or 0 for x in numbers) if len(p) > 1 else numbers[0]
                want.append((*([k] if scoped else []), i, p[-1], len(p), min(sigs, default=None), max(sigs, default=None), total, by[k, i][1]))
    assert one[0] == sorted(want, key=repr)
    monkeypatch.setattr(G, "ONE_TASK_POSTS", 10)
    counts = []
    contract = G.contract

    def counted(*args):
        nodes, left = contract(*args)
        counts.extend(left)
        return nodes, left

    monkeypatch.setattr(G, "contract", counted)
    assert found() == one
    assert len(counts) >= 3 and all(b < a for a, b in zip(counts, counts[1:]))


@pytest.mark.parametrize("bound,rows", [(10, 200_000), (1_000_000, 3)])
def test_giant_threads_take_the_jumps(spark, monkeypatch, bound, rows):
    edges = [(0, None), *((i, i - 1) for i in range(1, 40)), (50, None), (51, 50), (52, 50), (60, 61), (61, 60)]
    monkeypatch.setattr(G, "ONE_TASK_POSTS", bound)
    monkeypatch.setattr(G, "WALK_ROWS", rows)
    assert spark_paths(posts(spark, chain(*edges))) == brute_paths(edges)


def test_leaves_of_many_rounds_are_found_by_one_join(spark, monkeypatch):
    """The finished posts of all rounds meet the answered ones once, not round by round."""
    monkeypatch.setattr(G, "ONE_TASK_POSTS", 10)
    rows = [(i, i - 1 if i % 40 else None) for i in range(200)] + [(300, 17), (301, 302), (302, 301)]
    leaves = G.thread_leaves(spark.createDataFrame(rows, "tweet_id long, in_reply_to long"))
    plan = leaves._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Join ") for line in plan.splitlines()) == 1
    assert sorted(map(tuple, leaves.collect())) == [(0, 39, 40), (0, 300, 19), *[(k, k + 39, 40) for k in (40, 80, 120, 160)]]


def test_flags_build_their_posts_once(spark):
    """Posts that are costly to build are read by one job, whatever looks at them afterwards."""
    built = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            built.add(batch.num_rows)
            yield batch

    df = conversation(spark)
    counted = df.mapInArrow(count, df.schema)
    assert sorted(T.thread_flags(counted).collect(), key=str) == sorted(T.thread_flags(df).collect(), key=str)
    assert built.value == df.count()
