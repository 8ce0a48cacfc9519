"""Records of large text files whose ends depend on all that stands before: quoted CSV and JSON arrays.

Spark's text reader cuts a file into byte ranges and gives each range the pieces that begin in it, here lines or what ends in ``}``. Whether
a piece ends a record depends on the quotes (and brackets) before it. So every range is first summarised as a table of
transitions: where it leads from outside a string and from inside one. Composing these tables in the order of the
ranges gives the state in which each range begins, and then all ranges are cut into records at the same time. Records that
cross ranges are joined from their fragments, of which a range has two at most.

Only Spark's reader touches the files, so they can lie in any store that it reads.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_DEPTH = np.zeros(256, np.int8)
_DEPTH[[ord("{"), ord("[")]] = 1
_DEPTH[[ord("}"), ord("]")]] = -1
#: Bytes of the pieces that are looked at together; their arrays take some ten times as much.
SLICE_BYTES = 4_000_000


@dataclass(frozen=True)
class Cut:
    """How a format is cut: the character that ends a piece, and whether brackets and backslashes count.

    A record ends after a piece outside of strings, at the depth of an array's elements where brackets count.
    """

    end: str
    nested: bool

    def fresh(self, inside: int, depth: int, start: int) -> bool:
        """Whether a record begins in this state."""
        return start == 0 or not inside and (not self.nested or depth == 1)


CSV_LINES, JSON_ELEMENTS = Cut("\n", False), Cut("}", True)


def _transitions(column: pa.Array, cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """After each piece, from the first on: parity of quotes, depth from outside and from inside a string."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    quotes = np.flatnonzero(data == _QUOTE)
    if cut.nested and len(quotes):
        place = np.where(data == _BACKSLASH, -1, np.arange(len(data), dtype=np.int32 if len(data) < 2**31 else np.int64))
        place[offsets[:-1][offsets[:-1] < len(data)]] = np.maximum(place[offsets[:-1][offsets[:-1] < len(data)]], offsets[:-1][offsets[:-1] < len(data)] - 1)
        last = np.maximum.accumulate(place)
        before = np.where(quotes > 0, last[quotes - 1], -1)
        begins = offsets[np.searchsorted(offsets, quotes, "right") - 1]
        run = quotes - 1 - np.maximum(before, begins - 1)
        quotes = quotes[run % 2 == 0]
    parity = np.searchsorted(quotes, offsets[1:], "left") & 1
    if not cut.nested:
        zero = np.zeros(len(parity), np.int64)
        return parity, zero, zero
    brackets = np.flatnonzero(_DEPTH[data])
    change, within = _DEPTH[data[brackets]], np.searchsorted(quotes, brackets, "left") & 1
    upto = np.searchsorted(brackets, offsets[1:], "left")
    depths = []
    for inside in (0, 1):
        outside = within == inside  # from inside a string, odd quotes stand outside
        total = np.concatenate(([0], np.cumsum(np.where(outside, change, 0))))[upto]
        depths.append(total - np.cumsum(parity == inside))  # the closing bracket that ends the piece
    return parity, depths[0], depths[1]


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """The texts of a column in their order, up to ``SLICE_BYTES`` at a time and at least one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
        yield column.slice(at, to - at)
        at, done = to, ends[to - 1]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, pa.Array]]:
    """((file, start), whether the range is new, pieces) of runs of rows in the order they were read."""
    key = None
    for batch in batches:
        starts, files = batch.column("start").to_numpy(), batch.column("file").dictionary_encode()
        names = files.indices.to_numpy()
        change = np.flatnonzero((starts[1:] != starts[:-1]) | (names[1:] != names[:-1])) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            if a < b:
                this = (files.dictionary[int(names[a])].as_py(), int(starts[a]))
                for part in slices(batch.column("value").slice(a, b - a)):
                    yield this, this != key, part
                    key = this


def _summaries(pieces: DataFrame, cut: Cut) -> DataFrame:
    """(file, start, parity, outside, inside): where each range leads."""

    def work(batches):
        key, state = None, (0, 0, 0)
        rows = []
        for this, new, column in _ranges(batches):
            if new and key is not None:
                rows.append((*key, *state))
            parity, outside, inside = (int(x[-1]) for x in _transitions(column, cut))
            p, o, i = (0, 0, 0) if new else state
            state = (p ^ parity, o + (inside if p else outside), i + (outside if p else inside))
            key = this
        if key is not None:
            rows.append((*key, *state))
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["file", "start", "parity", "outside", "inside"])

    return pieces.mapInArrow(work, "file string, start long, parity long, outside long, inside long")


def _states(pieces: DataFrame, cut: Cut) -> tuple[dict[tuple[str, int], tuple[int, int]], bool]:
    """State (inside a string, depth) at the beginning of every range, and whether any string crosses an end of a range.

    The driver holds one entry for each range, as it does for the tasks of the reader.
    """
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    composed = _summaries(pieces, cut).withColumn("s", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2)
    step = F.when(F.col("s") == 0, F.col("outside")).otherwise(F.col("inside"))
    composed = composed.withColumn("step", step).withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0)))
    rows = composed.select("file", "start", "s", "depth", "parity").collect()
    return {(r["file"], r["start"]): (r["s"], r["depth"]) for r in rows}, any(r["s"] != r["parity"] or r["s"] for r in rows)


#: Kinds of rows: a whole record, the end of one that began before, the beginning of one that goes on, and neither end.
WHOLE, END, BEGINNING, MIDDLE = range(4)


def split_records(spark: SparkSession, path: str | Sequence[str], cut: Cut) -> DataFrame:
    """(text, first): the records of the files, and whether each is the first of its file.

    What follows the last complete element of an array is left out; the last record of a CSV file counts even if its quotes
    do not close. Files change between the two scans at their reader's risk: a range without a summary raises an error.
    """
    raw = spark.read.option("lineSep", cut.end).text(list(path) if not isinstance(path, str) else path)
    pieces = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    states, crossed = _states(pieces, cut)
    shared = spark.sparkContext.broadcast(states)  # one entry for each task of the reader
    schema = "file string, start long, number long, kind int, first boolean, text string"

    def records(whole: bool):
        def work(batches):
            held: list[str] = []  # pieces since the last end
            key, state, begun, number = None, (0, 0), True, 0
            out: list[list] = [[] for _ in range(6)]
            size = 0  # bytes of the pieces since the last batch

            def put(kind: int, pieces: list[str]) -> None:
                nonlocal number
                if (kind == WHOLE) == whole:
                    for column, x in zip(out, (*key, number, kind, key[1] == 0 and number == 0, cut.end.join(pieces))):
                        column.append(x)
                number += 1

            def close() -> None:
                if key is not None and held:
                    put(BEGINNING if begun else MIDDLE, held)

            def flush():
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
                batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["file", "start", "number", "kind", "first", "text"])
                for column in out:
                    column.clear()
                return batch

            for this, new, column in _ranges(batches):
                if new:
                    close()
                    if this not in shared.value:
                        raise ValueError(f"no summary of {this}: the files or the size of their ranges changed")
                    key, state, held, number = this, shared.value[this], [], 0
                    begun = cut.fresh(*state, this[1])
                parity, outside, inside = _transitions(column, cut)
                s, depth = state
                after = s ^ parity
                level = depth + (inside if s else outside)
                ends = np.flatnonzero((after == 0) & (level == 1) if cut.nested else after == 0).tolist()
                state = int(after[-1]), int(level[-1])
                texts = column.to_pylist()
                at = 0
                for e in ends:
                    put(WHOLE if begun else END, held + texts[at : e + 1])
                    held, begun, at = [], True, e + 1
                held = held + texts[at:]
                size += column.nbytes
                if len(out[0]) >= 5000 or size >= SLICE_BYTES:
                    yield flush()
                    size = 0
            close()
            yield flush()

        return work

    complete = pieces.mapInArrow(records(True), schema).select("text", "first")
    if not cut.nested and not crossed:
        return complete
    order = W.partitionBy("file").orderBy("start", "number")
    parts = pieces.mapInArrow(records(False), schema).withColumn("owner", F.sum(F.when(F.col("kind") == BEGINNING, 1).otherwise(0)).over(order))
    crossing = parts.groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("start", "number", "text"))).alias("parts"), F.max(F.col("kind") == END).alias("ended"),
        F.max("first").alias("first"),
    )
    if cut.nested:
        crossing = crossing.where("ended")
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), cut.end)
    return complete.unionByName(crossing.select(joined.alias("text"), "first"))


def read_csv_records(spark: SparkSession, path: str | Sequence[str], schema: StructType, header: bool = True) -> DataFrame:
    """Quoted CSV whose fields may span lines, read by as many tasks as its bytes give.

    Quotes inside a quoted field are doubled, and a field with a quote is quoted (RFC 4180); read other files with Spark's
    own ``multiLine`` reader. Empty lines are skipped, and columns go by their place, whatever the header says.
    """
    records = split_records(spark, path, CSV_LINES)
    if header:
        records = records.where(~F.col("first"))
    text = F.regexp_replace("text", r"\r\z", "")
    rows = records.select(text.alias("text")).where(F.trim("text") != "")
    return rows.select(F.from_csv("text", schema.toDDL(), {"quote": '"', "escape": '"'}).alias("r")).select("r.*")


def read_json_elements(spark: SparkSession, path: str | Sequence[str], schema: StructType, malformed: bool = False) -> DataFrame:
    """Files that hold one JSON array of objects each, read by as many tasks as their bytes give.

    Objects that cannot be parsed are left out; ``malformed`` keeps them as rows of nulls. A file that is cut off right
    before the last bracket of an object counts as if it were there.
    """
    records = split_records(spark, path, JSON_ELEMENTS)
    element = F.concat(F.regexp_replace("text", r"^[\uFEFF\s,\[]+", ""), F.lit("}"))
    marked = StructType(list(schema.fields)).add("_malformed", "string")
    parsed = records.select(F.from_json(element, marked, {"columnNameOfCorruptRecord": "_malformed"}).alias("r"))
    good = parsed if malformed else parsed.where("r is not null and r._malformed is null")
    return good.select(*[F.col(f"r.`{f.name}`") for f in schema.fields])
