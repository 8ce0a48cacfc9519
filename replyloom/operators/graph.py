"""Reply graph: edges, roots, ancestors and root-to-leaf paths.

Measures fold along the paths by tree contraction. In a round a quarter of the posts, drawn by coins
so that none of them answers another, is spliced out: their answers point past them and take over what
they held. Answers of finished posts are finished. So a round reads the survivors of the one before,
a falling number of rows of constant size; afterwards the spliced posts are filled in, last round
first. A table of up to ``ONE_TASK_POSTS`` pointers is followed in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from replyloom.runtime import hottest_key, materialize, salted_join

#: Up to this many posts one task follows all pointers; whole threads are walked this many posts at a time.
ONE_TASK_POSTS, WALK_ROWS = 1_000_000, 200_000


def reply_edges(posts: DataFrame) -> DataFrame:
    """(parent_id, child_id) for every reply whose parent is in the table."""
    children = posts.where(F.col("in_reply_to").isNotNull()).select(
        F.col("in_reply_to").alias("parent_id"), F.col("tweet_id").alias("child_id")
    )
    ids = posts.select(F.col("tweet_id").alias("parent_id"))
    return salted_join(children, ids, ["parent_id"], "left_semi", spread=["child_id"])


def thread_roots(posts: DataFrame) -> DataFrame:
    """Posts without a parent, or whose parent is not in the table."""
    keyed = posts.withColumn("_parent", F.col("in_reply_to"))
    ids = posts.select(F.col("tweet_id").alias("_parent"))
    return salted_join(keyed, ids, ["_parent"], "left_anti", spread=["tweet_id"]).select(
        *posts.columns
    )


def ancestor_closure(posts: DataFrame, seed: DataFrame, max_hops: int = 3) -> DataFrame:
    """The seed posts and their ancestors up to ``max_hops`` parents away.

    Each hop looks up the distinct ids still missing, so both sides of its join have unique keys.
    """
    columns = posts.columns
    known = materialize(seed.select("tweet_id", "in_reply_to"), "closure")
    frontier = known
    added: list[DataFrame] = []
    for _ in range(max_hops):
        wanted = (
            frontier.where(F.col("in_reply_to").isNotNull())
            .select(F.col("in_reply_to").alias("tweet_id"))
            .distinct()
            .join(known.select("tweet_id"), "tweet_id", "left_anti")
        )
        found = materialize(posts.join(wanted, "tweet_id", "left_semi"), "closure")
        if found.isEmpty():
            break
        added.append(found)
        frontier = found.select("tweet_id", "in_reply_to")
        known = known.unionByName(frontier)
    return reduce(DataFrame.unionByName, added, seed.select(*columns))


#: name -> (value of a single post, how two stretches of a path combine)
Measures = Mapping[str, tuple[Column, str]]

_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": F.least,
    "max": F.greatest,
    "own": lambda a, b: a,
}


@dataclass(frozen=True)
class Folded:
    """Result of following every post up to its root.

    ``nodes`` has (scope, tweet_id, root_id, depth, measures) for each post that reaches a root;
    posts on or below a cycle never do and are absent. ``leaves`` are the nodes nobody answers.
    """

    nodes: DataFrame
    leaves: DataFrame


def _parents(frame: pd.DataFrame, scope: Sequence[str]) -> np.ndarray:
    """Row of the post that each row answers, -1 for none. Ids are unique within a scope."""
    group = pd.MultiIndex.from_frame(frame[list(scope)]).factorize()[0] if scope else np.zeros(len(frame), np.int64)
    asks = frame["_up"].notna().to_numpy()
    keys = np.zeros(len(frame) + int(asks.sum()), [("group", "i8"), ("id", "i8")])
    keys["group"] = np.concatenate([group, group[asks]])
    keys["id"] = np.concatenate([frame["tweet_id"].to_numpy(dtype="int64"), frame["_up"][asks].to_numpy(dtype="int64")])
    codes = np.unique(keys, return_inverse=True)[1]
    place = np.full(len(keys), -1)
    place[codes[: len(frame)]] = np.arange(len(frame))
    parent = np.full(len(frame), -1)
    parent[asks] = place[codes[len(frame) :]]
    return parent


def _follow(parent: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Root of each row (-1 on or below a cycle), and the jumps of 1, 2, 4, ... steps."""
    n = len(parent)
    jumps, jump, rounds = [], np.append(parent, -1), max(1, int(n).bit_length())
    root = np.append(np.arange(n), -1)
    for _ in range(rounds):
        if (jump < 0).all():
            break
        jumps.append(jump)
        root = np.where(jump >= 0, root[jump], root)
        jump = jump[jump]
    return np.where(jump[:n] < 0, root[:n], -1), jumps


def _fold_column(values: pd.Series, how: str, jumps: list[np.ndarray]) -> np.ndarray | pd.Series:
    """The measure over the path of each row; nulls count as nothing, as in ``_COMBINE``."""
    if not pd.api.types.is_numeric_dtype(values.dtype):  # strings: their order is that of the column
        codes, names = pd.factorize(values, sort=True)
        whole = pd.Series(codes, dtype="Int64").mask(codes < 0)
        found = _fold_column(whole, how, jumps)
        return pd.Series([None if pd.isna(x) else names[x] for x in found], dtype=object)
    null = np.append(values.isna().to_numpy(), True)
    plain = "int64" if pd.api.types.is_integer_dtype(values.dtype) else "float64"
    x = np.append(values.fillna(0).to_numpy(dtype=plain), np.zeros(1, plain))
    for jump in jumps:
        other, missing = x[jump], null[jump]
        if how == "sum":
            x, null = x + np.where(jump >= 0, other, 0), null & (jump < 0)
        else:
            pick = np.minimum if how == "min" else np.maximum
            both = pick(x, other)
            x = np.where(null, other, np.where(missing, x, both))
            null = null & missing
    kind = "Int64" if plain == "int64" else "Float64"
    return pd.Series(x[:-1], dtype=kind).mask(null[:-1])


def _fold_here(start: DataFrame, scope: list[str], folds: dict[str, str]) -> DataFrame:
    """All pointers of a small table in one task."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in start.drop("_up").schema)

    def work(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        frame = pa.Table.from_batches(held).to_pandas(types_mapper=_nullable)
        root, jumps = _follow(_parents(frame, scope))
        good = root >= 0
        out = frame.drop(columns="_up")
        out["root_id"] = frame["tweet_id"].to_numpy(dtype="int64")[np.where(good, root, 0)]
        for name, how in folds.items():
            if how != "own":
                out[name] = _fold_column(frame[name], how, jumps)
        out = out[good]
        arrow = pa.Table.from_batches(held).schema.remove(held[0].schema.get_field_index("_up"))
        yield from pa.Table.from_pandas(out[arrow.names], schema=arrow, preserve_index=False).to_batches()

    return start.repartition(1).mapInArrow(work, schema)


def _nullable(kind: pa.DataType):
    """Integers with nulls stay integers."""
    return pd.Int64Dtype() if pa.types.is_integer(kind) else None


def fold_ancestors(
    posts: DataFrame, scope: Sequence[str] = (), measures: Measures | None = None
) -> Folded:
    """Combine measures over the path from each post up to its root."""
    scope, measures = list(scope), dict(measures or {})
    folds = {"depth": (F.lit(1).cast("long"), "sum"), **measures}
    start = materialize(
        posts.select(
            *scope,
            "tweet_id",
            F.col("in_reply_to").alias("_up"),
            F.col("tweet_id").alias("root_id"),
            *[value.alias(name) for name, (value, _) in folds.items()],
        ),
        "fold",
    )
    how = {name: kind for name, (_, kind) in folds.items()}
    if start.count() <= ONE_TASK_POSTS:
        nodes = materialize(_fold_here(start, scope, how), "folded")
    else:
        nodes, _ = contract(start, scope, how)
    answered = (
        start.where(F.col("_up").isNotNull())
        .select(*scope, F.col("_up").alias("tweet_id"))
        .distinct()
        .withColumn("_answered", F.lit(True))
    )
    # Not an anti join: Spark runs that once for each part of a union, and the parts in one task.
    met = nodes.join(answered, [*scope, "tweet_id"], "left")
    leaves = met.where(F.col("_answered").isNull()).drop("_answered")
    return Folded(nodes, leaves.withColumnRenamed("tweet_id", "leaf_id"))


def _below(rows: DataFrame, above: DataFrame, scope: list[str], folds: dict[str, str]) -> DataFrame:
    """``rows`` with what their parent in ``above`` holds, as ``_present``, ``_next`` and ``_root``, and
    the folds combined with it."""
    table = above.select(
        *scope, F.col("tweet_id").alias("_up"), F.lit(True).alias("_present"),
        F.col("_up").alias("_next"), F.col("root_id").alias("_root"), *[F.col(n).alias(f"_above_{n}") for n in folds],
    )
    met = salted_join(rows, table, [*scope, "_up"], "left", ["tweet_id"])
    present = F.col("_present").isNotNull()
    return met.withColumns(
        {n: F.when(present, _COMBINE[how](F.col(n), F.col(f"_above_{n}"))).otherwise(F.col(n)) for n, how in folds.items()}
    ).drop(*[f"_above_{n}" for n in folds])


def contract(start: DataFrame, scope: list[str], folds: dict[str, str], most: int | None = None) -> tuple[DataFrame, list[int]]:
    """Nodes of ``Folded`` by tree contraction, and the rows that were still open in each round."""
    most = ONE_TASK_POSTS if most is None else most
    columns = [*scope, "tweet_id", "_up", "root_id", *folds]
    key = [*scope, "_up"]
    ids = start.select(*scope, F.col("tweet_id").alias("_up"), F.lit(True).alias("_known"))
    linked = materialize(salted_join(start, ids, key, "left", ["tweet_id"]), "linked")
    root = F.col("_known").isNull()
    finished = [linked.where(root).withColumn("_up", F.lit(None).cast("long")).select(*columns)]
    open_rows = linked.where(~root).select(*columns)
    spliced: list[DataFrame] = []
    counts: list[int] = []

    def coin(name: str, turn: int) -> Column:
        return F.pmod(F.xxhash64(*scope, name, F.lit(turn)), F.lit(2)) == 1

    while (left := open_rows.count()) > most:
        counts.append(left)
        turn = len(counts)
        # First what answers a post that was finished in the round before, then splicing among the rest.
        met = materialize(_below(open_rows, finished[-1], scope, folds), "met")
        done = F.col("_present").isNotNull()
        finished.append(
            met.where(done).withColumns({"_up": F.lit(None).cast("long"), "root_id": F.col("_root")}).select(*columns)
        )
        rest = met.where(~done).select(*columns)
        drawn = coin("tweet_id", turn) & ~coin("_up", turn)
        spliced.append(rest.where(drawn))
        moved = materialize(_below(rest.where(~drawn), spliced[-1], scope, folds), "round")
        past = F.when(F.col("_present"), F.col("_next")).otherwise(F.col("_up"))
        # what points to itself hangs on a cycle
        open_rows = moved.withColumn("_up", past).where(F.col("_up") != F.col("tweet_id")).select(*columns)
    if left:
        wanted = open_rows.select(*scope, F.col("_up").alias("tweet_id")).distinct()
        heads = finished[-1].join(wanted, [*scope, "tweet_id"], "left_semi")
        marked = heads.select(*columns).withColumn("_head", F.lit(True)).unionByName(open_rows.withColumn("_head", F.lit(False)))
        solved = materialize(_fold_rest(marked, scope, folds), "rest")
        finished.append(solved.where(~F.col("_head")).drop("_head").withColumn("_up", F.lit(None).cast("long")).select(*columns))
    known = finished[len(counts) + 1 :]
    for turn in reversed(range(len(spliced))):
        known.append(finished[turn + 1])
        above = reduce(DataFrame.unionByName, known)
        filled = materialize(_below(spliced[turn], above, scope, folds), "filled").where(F.col("_present").isNotNull())
        known.append(filled.withColumns({"_up": F.lit(None).cast("long"), "root_id": F.col("_root")}).select(*columns))
    return reduce(DataFrame.unionByName, [*known, finished[0]]).drop("_up"), counts


def _fold_rest(marked: DataFrame, scope: list[str], folds: dict[str, str]) -> DataFrame:
    """The last open rows below finished ones (``_head``, whose root is known) in one task."""
    named = marked.withColumnRenamed("root_id", "_root_of")
    solved = _fold_here(named.withColumn("root_id", F.col("tweet_id")), scope, folds)
    heads = solved.where("_head").select(*scope, F.col("tweet_id").alias("root_id"), F.col("_root_of").alias("_real"))
    reached = salted_join(solved.drop("_root_of"), heads, [*scope, "root_id"], spread=["tweet_id"])
    return reached.withColumn("root_id", F.col("_real")).drop("_real")


def thread_leaves(
    posts: DataFrame, scope: Sequence[str] = (), measures: Measures | None = None
) -> DataFrame:
    """One row per root-to-leaf path: (scope, root_id, leaf_id, depth, measures)."""
    scope = list(scope)
    leaves = fold_ancestors(posts, scope, measures).leaves
    return leaves.select(*scope, "root_id", "leaf_id", "depth", *(measures or {}))


def path_members(posts: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Every post of every root-to-leaf path: (scope, root_id, leaf_id, depth, position, tweet_id).

    Whole threads go to a task, which walks up from their leaves, some threads at a time. Threads of
    more than ``ONE_TASK_POSTS`` posts take the jumps of pointer doubling instead, from the longest to
    the shortest: each round can double the known members of a path, and no pair is produced twice.
    """
    scope = list(scope)
    linked = posts.select(*scope, "tweet_id", "in_reply_to")
    nodes = materialize(
        fold_ancestors(linked, scope, {"_parent": (F.col("in_reply_to"), "own")}).nodes, "threads"
    )
    giant = nodes.groupBy(*scope, "root_id").count().where(F.col("count") > ONE_TASK_POSTS).drop("count")
    giant = materialize(giant, "giant")
    if giant.isEmpty():
        return _walk_up(nodes, scope)
    key = [*scope, "root_id"]
    small = _walk_up(salted_join(nodes, giant, key, "left_anti", ["tweet_id"]), scope)
    large = salted_join(nodes, giant, key, "left_semi", ["tweet_id"])
    return small.unionByName(_apply_jumps(materialize(large, "giant"), scope))


def _walk_up(nodes: DataFrame, scope: list[str]) -> DataFrame:
    kinds = dict(nodes.dtypes)
    out = [*scope, "root_id", "leaf_id", "depth"]
    schema = ", ".join(f"`{c}` {kinds.get(c, 'bigint')}" for c in out) + ", position int, tweet_id bigint"

    def paths(table: pa.Table):
        frame = table.to_pandas(types_mapper=_nullable).rename(columns={"_parent": "_up"})
        parent = _parents(frame, [*scope, "root_id"])
        leaves = np.ones(len(frame), bool)
        leaves[parent[parent >= 0]] = False
        ids, depth = table.column("tweet_id"), frame["depth"].to_numpy(dtype="int64")
        leaf = at = np.flatnonzero(leaves)
        while len(leaf):
            yield pa.RecordBatch.from_arrays(
                [
                    *(table.column(c).take(pa.array(leaf)).combine_chunks() for c in (*scope, "root_id", "tweet_id", "depth")),
                    pa.array((depth[at] - 1).astype("int32")), ids.take(pa.array(at)).combine_chunks(),
                ],
                [*out, "position", "tweet_id"],
            )
            up = parent[at]
            leaf, at = leaf[up >= 0], up[up >= 0]

    def work(batches):
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            roots = batch.column("root_id").to_numpy()
            if rows >= WALK_ROWS:  # a new root begins a new thread: what lies before is whole
                new = np.flatnonzero(roots != np.append(last, roots[:-1]))
                if len(new):
                    yield from paths(pa.Table.from_batches([*held, batch.slice(0, new[0])]))
                    held, rows, batch = [], 0, batch.slice(new[0])
            held.append(batch)
            rows += batch.num_rows
            last = roots[-1]
        if held:
            yield from paths(pa.Table.from_batches(held))

    cores = max(nodes.sparkSession.sparkContext.defaultParallelism, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = nodes.select(*scope, "root_id", "tweet_id", "_parent", "depth").repartition(cores, *scope, "root_id")
    return dealt.sortWithinPartitions(*scope, "root_id").mapInArrow(work, schema)


def _doubled(nodes: DataFrame, scope: list[str]) -> list[DataFrame]:
    """``jumps[k]`` maps a post to its ancestor 2**k steps up."""
    step = nodes.where(F.col("depth") > 1).select(*scope, "tweet_id", F.col("_parent").alias("_up"))
    jumps = []
    while True:
        load = hottest_key(step, [*scope, "_up"])
        if load[0] == 0:
            return jumps
        jumps.append(step)
        above = step.select(*scope, F.col("tweet_id").alias("_up"), F.col("_up").alias("_next"))
        step = materialize(
            salted_join(step, above, [*scope, "_up"], "inner", ["tweet_id"], load).select(*scope, "tweet_id", F.col("_next").alias("_up")), "jumps"
        )


def _apply_jumps(nodes: DataFrame, scope: list[str]) -> DataFrame:
    jumps = _doubled(nodes, scope)
    answered = nodes.select(*scope, F.col("_parent").alias("leaf_id")).distinct()
    leaves = nodes.withColumnRenamed("tweet_id", "leaf_id").join(answered, [*scope, "leaf_id"], "left_anti")
    ends = leaves.select(
        *scope, "root_id", "leaf_id", "depth", F.col("leaf_id").alias("tweet_id"),
        F.lit(0).cast("long").alias("_back"),
    )
    parts = [materialize(ends, "members")]
    for k in reversed(range(len(jumps))):
        reach = reduce(DataFrame.unionByName, parts).where(
            F.col("_back") + F.lit(2**k) < F.col("depth")
        )
        further = (
            salted_join(
                reach, jumps[k], [*scope, "tweet_id"], spread=["leaf_id", "_back"]
            )
            .withColumn("_back", F.col("_back") + F.lit(2**k))
            .drop("tweet_id")
            .withColumnRenamed("_up", "tweet_id")
        )
        parts.append(materialize(further, "members"))
    members = reduce(DataFrame.unionByName, parts)
    return members.select(
        *scope, "root_id", "leaf_id", "depth",
        (F.col("depth") - 1 - F.col("_back")).cast("int").alias("position"), "tweet_id",
    )


def branching_threads(leaves: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Roots with more than one leaf, and their number of leaves."""
    return (
        leaves.groupBy(*scope, "root_id")
        .agg(F.count(F.lit(1)).alias("leaves"))
        .where(F.col("leaves") > 1)
    )


def depth_stats(leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Paths, average, exact median and maximal depth, and shares of paths of depth >= 3 and >= 4.

    Depths are first counted per value, so the median is read off a small histogram instead of
    sorting all paths of a group in one task.
    """
    by = list(by)
    group = W.partitionBy(*(by or [F.lit(0)]))
    counts = (
        leaves.groupBy(*by, "depth")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_all", F.sum("n").over(group))
        .withColumn("_upto", F.sum("n").over(group.orderBy("depth")))
    )
    n, depth, upto = F.col("n"), F.col("depth"), F.col("_upto")

    def ranked(rank: Column) -> Column:
        return F.min(F.when(upto >= rank, depth))

    def share(least: int) -> Column:
        return F.sum(F.when(depth >= least, n).otherwise(0)) / F.sum("n") * 100

    return counts.groupBy(*by).agg(
        F.sum("n").alias("paths"),
        (F.sum(n * depth) / F.sum("n")).alias("avg_depth"),
        ((ranked(F.floor((F.col("_all") + 1) / 2)) + ranked(F.floor(F.col("_all") / 2) + 1)) / 2)
        .alias("median_depth"),
        F.max("depth").alias("max_depth"),
        share(3).alias("pct_depth_ge_3"),
        share(4).alias("pct_depth_ge_4"),
    )
