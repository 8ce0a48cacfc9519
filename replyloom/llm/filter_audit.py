"""Audit of interacting text filters by incremental retraction on a stream.

All files of a folder go through a Structured Streaming query in available-now micro-batches. The conditions on the text alone are
column expressions. Whether a text repeats that of a smaller id is state: for every distinct text the smallest id seen so far,
its part and its marks. Rows of a smaller id that arrive later take that place and retract the mask of the rows that held it (minus one
without the duplicate bit, plus one with it) from the counters of their part. The sink holds these changes; their sum is the number
of documents by (part, mask, marks), from which every order of the filters follows.

Texts are kept in state by SHA-256, in buckets: one state value holds the texts of a bucket as an Arrow table, so a task
works on whole columns. Copies of a text are first added up inside each task, so a text with most of the rows costs each
task one row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from replyloom.runtime import work_folder

#: Micro-batches that the files of a table are dealt to; each rewrites the state and reads the labels once.
BATCHES = 4
#: Rows of the table for each bucket of the state, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 48
#: From this many rows on the state is kept on disk (RocksDB), as it may outgrow the executors' memory; smaller state goes where the
#: session says. The counts are the same.
DISK_ROWS = 20_000_000
#: Rows that a task adds up at once before it sends them.
COMBINE_ROWS = 200_000

_WORDS = r"[\x20\x09-\x0D]+"


def text_checks(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text without null; E is the state's."""
    words = F.filter(F.split(text, _WORDS), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _combine(table: pa.Table, buckets: int) -> pa.RecordBatch:
    """One row for each (text, part, marks): its least id, the rows with that id and the rows above it.

    Rows without an id are not in any order: they are only counted, under an empty text.
    """
    ids = table.column("id").to_numpy().astype(float, copy=False) if table.column("id").null_count else None
    keys = table.column("key").to_pylist()
    frame = pd.DataFrame({
        "key": keys, "part": table.column("part").to_pylist(), "mask": table.column("mask").to_numpy(), "marks": table.column("marks").to_numpy(),
        "id": table.column("id").fill_null(0).to_numpy(),
    })
    if ids is not None:
        missing = np.isnan(ids)
        frame.loc[missing, "key"] = b""
    by = ["key", "part", "mask", "marks"]
    least = frame.groupby(by, sort=False)["id"].transform("min")
    frame["at"] = (frame["id"] == least).astype("int64")
    out = frame.groupby(by, sort=False).agg(id=("id", "min"), at=("at", "sum"), n=("id", "size")).reset_index()
    lost = out["key"].map(len) == 0
    bucket = [int.from_bytes(k[:8] or p.encode()[-7:], "little") % buckets for k, p in zip(out["key"], out["part"])]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket, pa.int32()), pa.array(out["key"], pa.binary()), pa.array(out["part"], pa.string()), pa.array(out["mask"], pa.int32()),
            pa.array(out["marks"], pa.int32()), pa.array(out["id"], pa.int64(), mask=lost.to_numpy()), pa.array(np.where(lost, out["n"], out["at"]), pa.int64()),
            pa.array(np.where(lost, 0, out["n"] - out["at"]), pa.int64()),
        ],
        ["bucket", "key", "part", "mask", "marks", "id", "n", "above"],
    )


def _packed(frame: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(frame, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


_STATE_COLUMNS = ["key", "part", "mask", "marks", "id", "n"]


def _advance(held: pd.DataFrame, rows: pd.DataFrame, bit: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The state after ``rows``, and the changes of the counters (part, mask, marks, n)."""
    everything = pd.concat([held.assign(above=0, old=True), rows.assign(old=False)], ignore_index=True)
    least = everything.groupby("key", sort=False)["id"].transform("min")
    first = everything["id"] == least
    failed = everything["mask"] | bit
    new = ~everything["old"]
    change = ["part", "mask", "marks", "n"]
    changes = pd.concat([
        everything[new & first][change],
        everything[new & ~first].assign(mask=failed)[change],
        everything[new].assign(mask=failed, n=everything["above"])[change],
        everything[~new & ~first].assign(n=-everything["n"])[change],  # the smallest id is another one now
        everything[~new & ~first].assign(mask=failed)[change],
    ])
    state = everything[first].groupby(["key", "part", "mask", "marks", "id"], sort=False, as_index=False)["n"].sum()
    return state[_STATE_COLUMNS], changes


@contextmanager
def _state_on_disk(spark: SparkSession, needed: bool):
    """Streams that start inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    if needed:
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    if needed:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def audit_changes(
    spark: SparkSession, path: str, labels: DataFrame, checks=text_checks, text: str = "text", part: str = "source", doc_id: str = "doc_id",
    batches: int = BATCHES, folder: str | None = None,
) -> DataFrame:
    """Stream all Parquet files of ``path``; changes (part, mask, marks, n) as the sink holds them.

    Bit i of a mask is set where the i-th check fails; the bit after the last one where the text equals that of a smaller id. Bit 0 of
    ``marks`` is quality = 1, bit 1 toxic = 1; of several labels of an id each that holds counts. ``folder`` (by default
    a new one in the shared work folder) keeps the checkpoint: the same folder goes on where a stopped run left off and reads new files only.
    """
    table = spark.read.parquet(path)
    files = max(1, len(table.inputFiles()))
    rows = table.count()  # reads footers only
    buckets = max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))
    folder = folder or f"{work_folder(spark).rstrip('/')}/replyloom/audit-{uuid.uuid4().hex}"
    marks = labels.select(
        F.col(doc_id).cast("long").alias("id"),
        F.when(F.col("quality") == 1, 1).otherwise(0).alias("good"), F.when(F.col("toxic") == 1, 2).otherwise(0).alias("bad"),
    ).where("id is not null and good + bad > 0")
    marks = marks.groupBy("id").agg((F.max("good") + F.max("bad")).alias("marks"), F.lit(0).alias("salt"))

    parent, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(f"{parent}/{{{name}}}")
    full = F.coalesce(F.col(text).cast("string"), F.lit(""))
    failures = list(checks(F.col("full")).values())
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures)), F.lit(0))
    bit = 1 << len(failures)
    slim = stream.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), full.alias("full")).select(
        "id", "part", F.unhex(F.sha2("full", 256)).alias("key"), mask.cast("int").alias("mask")
    )
    # Rows without an id have no label; they are dealt out, or all of them would meet in one task.
    slim = slim.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.hash("key"), F.lit(1024)) + 1).otherwise(0))
    marked = slim.join(marks, ["id", "salt"], "left").select("id", "part", "key", "mask", F.coalesce("marks", F.lit(0)).alias("marks"))

    def combine(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in found:
            held.append(batch)
            size += batch.num_rows
            if size >= COMBINE_ROWS:
                yield _combine(pa.Table.from_batches(held), buckets)
                held, size = [], 0
        if size:
            yield _combine(pa.Table.from_batches(held), buckets)

    def advance(key: tuple, found: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None
        out = []
        for rows in found:
            lost = rows["id"].isna()
            out.append(rows[lost][["part", "mask", "marks", "n"]])
            rows = rows[~lost].drop(columns="bucket").astype({"id": "int64"})
            if len(rows):
                held, changes = _advance(rows[_STATE_COLUMNS].iloc[:0] if held is None else held, rows, bit)
                out.append(changes)
        if held is not None:
            state.update((_packed(held),))
        total = pd.concat(out).groupby(["part", "mask", "marks"], as_index=False)["n"].sum()
        yield total.astype({"mask": "int32", "marks": "int32", "n": "int64"})

    schema = "part string, mask int, marks int, n long"
    changes = (
        marked.mapInArrow(combine, "bucket int, key binary, part string, mask int, marks int, id long, n long, above long")
        .groupBy("bucket")
        .applyInPandasWithState(advance, schema, "texts binary", "append", GroupStateTimeout.NoTimeout)
    )
    query = changes.writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint")
    with _state_on_disk(spark, rows >= DISK_ROWS):
        query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/changes")


def filter_orders(letters: str = "ABCDE") -> list[tuple[str, int, int, int]]:
    """(order, step, mask of the filters before it, its bit) for every step of every order."""
    bits = {c: 1 << i for i, c in enumerate(letters)}
    return [
        ("".join(p), k + 1, sum(bits[c] for c in p[:k]), bits[p[k]]) for p in permutations(letters) for k in range(len(letters))
    ]


def audit_orders(changes: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """Counts of every step of every order for each part, from the changes (part, mask, marks, n)."""
    spark = changes.sparkSession
    counts = changes.groupBy("part", "mask", "marks").agg(F.sum("n").alias("n"))  # at most 4 * 2^filters rows a part
    orders = filter_orders(letters)
    size = len(letters)
    # A filter's part in an order depends on the set of filters before it alone.
    sets = sorted({(before, own) for _, _, before, own in orders})
    pairs = F.array(*[
        F.struct(F.lit(b).alias("before"), F.lit(o).alias("own"), F.lit(factorial(b.bit_count()) * factorial(size - 1 - b.bit_count())).alias("weight"))
        for b, o in sets
    ])
    each = counts.withColumn("pair", F.explode(pairs)).select("part", "mask", "marks", "n", "pair.*")
    passed, fails = F.col("mask").bitwiseAND(F.col("before")) == 0, F.col("mask").bitwiseAND(F.col("own")) != 0
    marked = {bit: F.col("marks").bitwiseAND(F.lit(bit)) != 0 for bit in (1, 2)}

    def number(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long").alias(name)

    steps = each.groupBy("part", "before", "own", "weight").agg(
        number(passed & ~fails, "kept"), number(passed & fails, "removed"), number(~passed & fails, "redundant"),
        number(F.col("mask") == F.col("own"), "unique_fails"),
        number(passed & fails & marked[1], "good_lost"), number(passed & fails & marked[2], "toxic_lost"),
    )
    shapley = steps.groupBy("part", "own").agg(F.sum(F.col("removed") * F.col("weight")).cast("long").alias("shapley"))
    table = spark.createDataFrame(orders, "filter_order string, step int, before int, own int")  # a fixed number of rows
    return steps.join(shapley, ["part", "own"]).join(F.broadcast(table), ["before", "own"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def filter_audit(spark: SparkSession, path: str, labels: DataFrame, **options) -> DataFrame:
    """What each filter removes at each place of each order, for every part of the Parquet files of ``path``.

    Null texts are empty texts, null parts the part ''. A row repeats another where its text equals that of a smaller id; rows of one id do not
    repeat each other, and a row without an id neither repeats nor is repeated. Repeated rows each count. An empty
    table gives no rows. Other columns are not read. ``options`` are those of ``audit_changes``.
    """
    return audit_orders(audit_changes(spark, path, labels, **options))
