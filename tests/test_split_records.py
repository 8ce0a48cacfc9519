"""Quoted CSV and JSON arrays read by byte ranges, against whole-file parsers."""

import csv
import io
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from replyloom.sources import posts as SP
from replyloom.sources import split_records as R

FIELDS = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("more", T.StringType())])
ODD = ['', 'a', '"', '""', ',', '\n', '\r\n', '\\', '\\"', 'é', ' ', '}', '{', '[', ']', '"}', '\\\\"', ' x ', "word " * 9, '\n\n"\n', '","', '}{"a":"']


@pytest.fixture(params=[97, 100_000])
def ranges(spark, request):
    """Byte ranges smaller than a record, and of whole files."""
    names = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k in names:
        spark.conf.unset(k)


def texts(seed, n=60):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(ODD) for _ in range(rng.randrange(6))) or None, "".join(rng.choice(ODD) for _ in range(rng.randrange(3))) or "m") for i in range(n)]


def write_csv(path, rows, end="\n", last=True):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
    writer.writerow(["id", "the\nheader", "more"])
    writer.writerows([(i, '' if t is None else t, m) for i, t, m in rows])
    text = out.getvalue()
    path.write_bytes((text if last else text[: -len(end)]).encode())


@pytest.mark.parametrize("end,last", [("\n", True), ("\r\n", True), ("\n", False)])
def test_csv_equals_the_parser(spark, tmp_path, ranges, end, last):
    wanted = []
    for k in range(3):
        rows = texts(k)
        write_csv(tmp_path / f"{k}.csv", rows, end, last)
        wanted += rows
    frame = R.read_csv_records(spark, str(tmp_path), FIELDS)
    if ranges == 97:
        assert frame.rdd.getNumPartitions() > 30
    got = sorted(((r["id"], r["text"] or None, r["more"]) for r in frame.collect()), key=repr)
    # fields that only hold white space or a lone line end are trimmed by no reader; compare them as they are
    assert got == sorted(wanted, key=repr)


def test_csv_equals_spark(spark, tmp_path, ranges):
    rows = [(i, (t or "x").replace("\\", ""), m.replace("\\", "") or "m") for i, t, m in texts(9)]
    write_csv(tmp_path / "a.csv", rows)
    own = R.read_csv_records(spark, str(tmp_path), FIELDS)
    theirs = spark.read.schema(FIELDS).option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    assert sorted(map(tuple, own.collect()), key=repr) == sorted(map(tuple, theirs.collect()), key=repr)


def test_csv_without_a_closing_quote(spark, tmp_path, ranges):
    (tmp_path / "a.csv").write_text('id,text,more\n1,a,b\n\n2,"open\nto the end')
    got = R.read_csv_records(spark, str(tmp_path), FIELDS).collect()
    assert [r["id"] for r in sorted(got)] == [1, 2]


def test_large_file_is_read_by_many_tasks(spark, tmp_path):
    """One file of posts with line breaks in every text."""
    path = tmp_path / "posts.csv"
    n = 20_000
    with path.open("w") as out:
        out.write("tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n")
        for i in range(n):
            out.write(f'{i},a{i},True,,"first ""line"" {i}\n\nsecond, {"x" * (i % 50)}",,{i - 1}.0\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        frame = SP.read_posts(spark, str(path))
        assert frame.rdd.getNumPartitions() >= 5
        got = frame.selectExpr("count(*) as n", "sum(tweet_id) as s", "count(distinct text) as t", "sum(in_reply_to) as p", "min(length(text)) as l").first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tuple(got) == (n, n * (n - 1) // 2, n, n * (n - 1) // 2 - n, len('first "line" 0\n\nsecond, '))


THING = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("inner", T.ArrayType(T.StructType([T.StructField("k", T.StringType())]))),
])


@pytest.mark.parametrize("indent", [None, 1])
def test_json_array_equals_the_parser(spark, tmp_path, ranges, indent):
    wanted = []
    for k in range(3):
        things = [{"id": i, "text": t, "inner": [{"k": m}, {"k": "}]"}, {}][: i % 4]} for i, t, m in texts(20 + k)]
        (tmp_path / f"{k}.json").write_text(json.dumps(things, indent=indent, ensure_ascii=k == 0) + "\n" * k)
        wanted += [(x["id"], x["text"], [(y.get("k"),) for y in x["inner"]]) for x in things]
    got = [(r["id"], r["text"], [tuple(x) for x in r["inner"]]) for r in R.read_json_elements(spark, str(tmp_path), THING).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("text,ids", [
    ("", []), ("[]", []), ("[ ]\n", []), ('﻿[{"id": 1}]', [1]), ('[{"id": 1}, {"id": x}, {"id": 3}]', [1, 3]), ('[{"id": 1}, {"id": 2,', [1]), ('[{"id": 1}, {"id": 2, "text": "x', [1]),
    ('[{"id":1,"text":"\\\\"},{"id":2,"text":"\\"}"}]', [1, 2]), ('[{},{"id":5}]', [None, 5]),
])
def test_odd_arrays(spark, tmp_path, ranges, text, ids):
    (tmp_path / "a.json").write_text(text)
    assert [r["id"] for r in sorted(R.read_json_elements(spark, str(tmp_path), THING).collect(), key=lambda r: r["id"] or 0)] == ids


def test_pieces_are_looked_at_in_short_slices():
    """A batch of long records is not scanned at once; a record above the limit comes alone."""
    texts = ["a" * 1_000_000] * 9 + [None, "b" * (R.SLICE_BYTES + 1), "", "c"]
    column = pa.array(["left out", *texts])
    batch = pa.RecordBatch.from_arrays([column, pa.array(["f"] * 14), pa.array([7] * 14)], ["value", "file", "start"]).slice(1)
    found = list(R._ranges(iter([batch, batch])))
    assert [x for _, _, part in found for x in part.to_pylist()] == texts * 2
    assert [new for _, new, _ in found] == [True] + [False] * (len(found) - 1)
    assert all(len(part) == 1 or sum(len(x or "") for x in part.to_pylist()) <= R.SLICE_BYTES for _, _, part in found)
