"""Queries over readers and writers: tables are written in each format and read back."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom import fixtures as X
from replyloom.functions.text import parse_post_time
from replyloom.runtime import work_folder
from replyloom.schemas import THREAD
from replyloom.sources import posts as SP
from replyloom.sources import threads as ST
from replyloom.sources.split_records import slices

POST_TIME = "EEE MMM dd HH:mm:ss Z yyyy"


def _place(s: SparkSession, name: str) -> str:
    return f"{work_folder(s).rstrip('/')}/replyloom/{name}-{uuid.uuid4().hex}"


def _post_time(s, d) -> DataFrame:
    said = F.date_format("ts", POST_TIME)
    return X.table(s, d, "events").select("event_id", parse_post_time(said).alias("at"))


def _post_files(s, d) -> DataFrame:
    """Events as post CSV, with quotes and line breaks inside the text."""
    path = _place(s, "posts")
    X.table(s, d, "events").select(
        F.col("event_id").alias("tweet_id"), F.concat(F.lit("user"), "user_id").alias("author_id"),
        F.when(F.col("event_type") == "error", "False").otherwise("True").alias("inbound"),
        F.date_format("ts", POST_TIME).alias("created_at"),
        F.concat("event_type", F.lit('\n"'), "event_type", F.lit('", x')).alias("text"),
        F.lit("").alias("response_tweet_id"),
        F.when(F.col("event_id") % 3 > 0, F.concat(F.col("event_id") - 1, F.lit(".0"))).alias(
            "in_response_to_tweet_id"
        ),
    ).write.option("header", True).option("escape", '"').csv(path)
    return SP.read_posts(s, path).select(
        "tweet_id", "author_id", "inbound", "created_at", "text", "in_reply_to"
    )


def _thread_files(s, d) -> DataFrame:
    """Conversations as thread lines."""
    turn = F.struct(
        F.col("turn").cast("int").alias("turn_index"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("tweet_id"), F.col("role").alias("speaker"),
        F.col("text").alias("scrubbed_text"), (F.col("role") == "system").alias("is_canned"),
        F.lit(None).cast("string").alias("macro_type"), F.lit(0.0).alias("gap_from_prev_hours"),
    )
    threads = X.table(s, d, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), F.max("turn").alias("_last"),
        F.min_by("text", "turn").alias("customer_inquiry_text"),
    ).select(
        F.concat(F.lit("c"), "conv_id").alias("thread_id"), (F.col("conv_id") * 100).alias("root_tweet_id"),
        (F.col("conv_id") * 100 + F.col("_last")).alias("leaf_tweet_id"),
        F.size("turns").alias("num_turns"), "customer_inquiry_text", "turns",
    )
    path = _place(s, "threads")
    ST.write_threads(threads, path)
    chars = F.aggregate("turns", F.lit(0), lambda n, t: n + F.length(t["scrubbed_text"]))
    return ST.read_threads(s, path).select(
        "thread_id", "leaf_tweet_id", "num_turns", chars.cast("long").alias("chars"),
        F.length("customer_inquiry_text").alias("inquiry_chars"),
    )


def _as_arrays(rows: DataFrame, path: str) -> None:
    """Write rows as JSON arrays, one array to a file and one file to a task."""
    lines = rows.select(F.to_json(F.struct("*")).alias("value"))

    def bracket(batches):
        first = True
        for batch in batches:
            for part in slices(batch.column("value")):
                texts = [f",{text}" for text in part.to_pylist()]
                if first:
                    texts[0] = f"[{texts[0][1:]}"
                yield pa.RecordBatch.from_pydict({"value": texts})
                first = False
        yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]})

    lines.mapInArrow(bracket, "value string").write.text(path)


def _document_arrays(s, d) -> str:
    source = _place(s, "array")
    _as_arrays(X.table(s, d, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("thread_id"), F.col("doc_id").alias("root_tweet_id"),
        F.col("text").alias("customer_inquiry_text"), F.col("lang").alias("initial_brand_reply"),
        F.struct(F.array("source").alias("agent_signatures")).alias("metadata"),
    ), source)
    return source


def _heads(threads: DataFrame) -> DataFrame:
    return threads.select(
        "thread_id", "root_tweet_id", F.md5("customer_inquiry_text").alias("digest"),
        F.length("customer_inquiry_text").alias("chars"), F.col("initial_brand_reply").alias("lang"),
        F.col("metadata.agent_signatures")[0].alias("source"),
    )


def _json_array(s, d) -> DataFrame:
    """Documents in JSON arrays, turned into lines."""
    target = _place(s, "lines")
    ST.convert_json_to_jsonl(s, _document_arrays(s, d), target, schema=THREAD)
    return _heads(ST.read_threads(s, target))


def _array_elements(s, d) -> DataFrame:
    """Documents in JSON arrays, read as they are."""
    return _heads(ST.read_json_array(s, _document_arrays(s, d), THREAD))


SQL_HEADS = """SELECT 'd' || doc_id AS thread_id, doc_id AS root_tweet_id, md5(text) AS digest, length(text)::int AS chars,
  lang, source FROM documents"""


def _taxonomy(s, d) -> DataFrame:
    """Every document as a taxonomy of its own: its language as tier, its source as intent."""
    odd = F.col("doc_id") % 2 == 1
    policy = F.struct(
        F.concat(F.lit("policy "), "doc_id").alias("action_policy"), odd.alias("override"),
        F.when(odd, F.array(F.substring("text", 1, 20), F.lit("B"))).alias("sub_intents"),
    )
    rules = X.table(s, d, "documents").where("lang is not null and source is not null").select(
        F.to_json(F.create_map("lang", F.create_map("source", policy))).alias("value")
    )
    return ST.taxonomy_table(rules, "value")


def _report(s, d) -> DataFrame:
    """Label counts behind a data gate, written as a report."""
    labels = ST.require(X.table(s, d, "labels"), 10, "toxic", 2)
    path = _place(s, "report")
    ST.write_report(labels.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n")), path)
    return s.read.schema("quality int, toxic int, n long").json(path)


ENTRIES = {
    "parse_post_time": (_post_time, "SELECT event_id, date_trunc('second', ts) AS at FROM events"),
    "post_files": (
        _post_files,
        "SELECT event_id AS tweet_id, 'user' || user_id AS author_id, event_type <> 'error' AS inbound, "
        "date_trunc('second', ts) AS created_at, event_type || chr(10) || '\"' || event_type || '\", x' AS text, "
        "CASE WHEN event_id % 3 > 0 THEN event_id - 1 END AS in_reply_to FROM events",
    ),
    "thread_files": (
        _thread_files,
        "SELECT 'c' || conv_id AS thread_id, conv_id * 100 + max(turn) AS leaf_tweet_id, count(*)::int AS num_turns, "
        "sum(length(text))::bigint AS chars, length(arg_min(text, turn))::int AS inquiry_chars "
        "FROM conversations GROUP BY conv_id",
    ),
    "json_array": (_json_array, SQL_HEADS),
    "array_elements": (_array_elements, SQL_HEADS),
    "taxonomy": (
        _taxonomy,
        "SELECT lang AS tier, source AS intent, sub AS sub_intent, doc_id % 2 = 1 AS override, "
        "'policy ' || doc_id AS action_policy FROM (SELECT *, unnest(CASE WHEN doc_id % 2 = 1 "
        "THEN [substr(text, 1, 20), 'B'] ELSE [NULL] END) AS sub FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)",
    ),
    "label_report": (_report, "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL"),
}
