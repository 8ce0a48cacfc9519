"""Shared helpers for multi-round jobs: durable intermediates, skew-safe joins, running sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A join key is hot when it holds more than 1/HOT_SHARE of the rows, so there are
#: never more than HOT_SHARE hot keys, whatever the size of the data.
HOT_SHARE = 200
#: Number of slices a hot key is cut into.
SALTS = 64
#: Largest limit for which Spark's optimizer prunes a ranked window per task.
GROUP_LIMIT = 1000
#: Below this many rows per key a plain equi join needs no salting.
COOL_ROWS = 200_000
#: Bytes of a row group of written blocks.
ROW_GROUP = 32_000_000


def work_folder(spark: SparkSession) -> str:
    """Folder for written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, as in tests,
    gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="replyloom-")
    sc.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` to the work folder and read it back.

    This cuts the lineage of iterative jobs and survives the loss of executors. The columnar
    copy also gives later rounds column pruning and a known size for join planning. ``options`` go
    to the writer.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark).rstrip('/')}/replyloom/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_blocks(
    rows: DataFrame, label: str, most: int, prepare: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None
) -> DataFrame:
    """The rows in their order, written ``most`` at a time as one binary column ``block`` (an Arrow stream).

    ``prepare`` may drop rows of a block.
    """

    def pack(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                part = part if prepare is None else prepare(part)
                if not part.num_rows:
                    continue
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

    # few rows of some MB each: small row groups, and their size looked at after every row
    return materialize(
        rows.mapInArrow(pack, "block binary"), label, **{"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1}
    )


def met_blocks(
    held: DataFrame, sent: DataFrame, work: Callable[..., Iterator[pa.RecordBatch]], schema: str, runs: bool = False
) -> DataFrame:
    """Rows of ``work(held block, sent block)`` for every pair of written blocks.

    A pair of blocks is read where it is compared, so neither side is copied by a shuffle. With ``runs`` the rows are
    those of ``work(iterator of held blocks, sent block)`` for the held blocks that follow one another in a task.
    """

    def rows(block: pa.Scalar) -> pa.Table:
        with pa.ipc.open_stream(block.as_buffer()) as stream:
            return stream.read_all()

    def pairs(batches):
        for batch in batches:
            yield from zip(batch.column("_sent"), batch.column("_held"))

    def each(batches):
        if runs:
            for _, run in groupby(pairs(batches), lambda pair: pair[0].as_buffer()):
                a, b = next(run)
                yield from work((rows(x) for x in chain((b,), (x for _, x in run))), rows(a))
        else:
            for a, b in pairs(batches):
                yield from work(rows(b), rows(a))

    met = sent.select(F.col("block").alias("_sent")).crossJoin(held.select(F.col("block").alias("_held")))
    return met.mapInArrow(each, schema)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rehash by ``key`` where the rows of the input lie in fewer tasks than half of the cores.

    A file with one row group is cut into several splits of which one holds all rows, so the splits
    with rows are counted (from the footers alone). Input with many splits is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > 4 * cores:
        return df
    if 2 * df.select(F.spark_partition_id().alias("p")).distinct().count() > cores:
        return df
    return df.repartition(cores, key)


def hottest_key(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Number of rows with a key, and rows of the most frequent key (map-side combined)."""
    counted = (
        df.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    )
    found = counted.agg(F.sum("n").alias("rows"), F.max("n").alias("top")).first()
    return found["rows"] or 0, found["top"] or 0


def salted_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
    load: tuple[int, int] | None = None,
) -> DataFrame:
    """Join a side with possibly very frequent keys to a side with unique keys.

    One aggregate finds the most frequent key (pass ``load`` where it is known). If no key is hot
    this is a plain equi join. Otherwise each hot key (see ``HOT_SHARE``) is cut into ``SALTS``
    slices by a hash of the ``spread`` columns, and only its single row on the other side is
    copied. At most ``HOT_SHARE`` keys can be hot, so their table is safe to broadcast. Rows with a
    null key match nothing and are spread as well. ``how`` may be ``inner``, ``left``,
    ``left_semi`` or ``left_anti``.
    """
    keys = list(keys)
    rows, top = load or hottest_key(many, keys)
    if top <= COOL_ROWS:
        return many.join(one, keys, how)
    limit = max(COOL_ROWS, rows // HOT_SHARE)
    hot = (
        many.where(F.col(keys[-1]).isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > limit)
        .select(*keys, F.lit(True).alias("_hot"))
    )
    hot = materialize(hot, "hot")
    slice_of = F.pmod(F.xxhash64(*(spread or many.columns)), F.lit(SALTS)).cast("int")
    spread_out = F.col("_hot") | F.col(keys[-1]).isNull()
    left = (
        many.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.when(spread_out, slice_of).otherwise(F.lit(0)))
        .drop("_hot")
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1)))
    right = (
        one.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.coalesce(copies, F.array(F.lit(0)))))
        .drop("_hot")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def first_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int, spread: Sequence[str],
    rank: str = "rank",
) -> DataFrame:
    """The first n rows of each group in the given total order, numbered from 1.

    Up to ``GROUP_LIMIT`` rows per group Spark prunes a ranked window per task before the shuffle.
    Above that a group is first ranked in slices, so that even a group with most of the rows never
    meets in one task: only n rows of each slice go on.
    """
    pruned = df
    if n > GROUP_LIMIT:
        piece = F.pmod(F.xxhash64(*spread), F.lit(SALTS))
        inner = W.partitionBy(*by, "_slice").orderBy(*order)
        pruned = (
            df.withColumn("_slice", piece)
            .withColumn("_n", F.row_number().over(inner))
            .where(F.col("_n") <= n)
            .drop("_slice", "_n")
        )
    numbered = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return pruned.withColumn(rank, numbered).where(F.col(rank) <= n)


def running_sums(
    df: DataFrame,
    order: Sequence[Column],
    sums: dict[str, Column],
    by: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Inclusive running sums over a total order without a single-partition window.

    Rows are range-partitioned and written once, so that every later read sees the same
    partitions. Each partition is summed on its own; the partition totals (one row per
    partition and group) carry the offsets. ``by`` columns start a new sum per group and
    should come first in the order implicitly.
    """
    spark = df.sparkSession
    by = list(by)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        df.repartitionByRange(n, *[F.col(c) for c in by], *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumns({f"_in_{k}": v for k, v in sums.items()}),
        "ranged",
    )
    totals = ranged.groupBy("_part", *by).agg(
        *[F.sum(f"_in_{k}").alias(f"_sum_{k}") for k in sums]
    )
    # At most (partitions x groups touching them) rows: every group adds its own boundary only.
    before = W.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy("_part").rowsBetween(
        W.unboundedPreceding, -1
    )
    offsets = totals.select(
        "_part",
        *by,
        *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in sums],
    )
    inside = W.partitionBy("_part", *by).orderBy(*order).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    result = ranged.withColumns({f"_run_{k}": F.sum(f"_in_{k}").over(inside) for k in sums})
    result = result.join(offsets, ["_part", *by])
    for k in sums:
        result = result.withColumn(k, F.col(f"_run_{k}") + F.col(f"_off_{k}"))
    extra = [f"{p}{k}" for k in sums for p in ("_in_", "_run_", "_off_")]
    return result.drop("_part", *extra)


def bin_index(value: Column, cuts: Sequence[float]) -> Column:
    """Number of ``cuts`` (ascending) that are <= ``value``, as a balanced comparison tree."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(cuts))
