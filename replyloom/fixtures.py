"""The bundled tables read as posts, threads, gold labels and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from replyloom.runtime import spread

#: tables of long texts, with the column that spreads them
_TEXT_KEYS = {"documents": "doc_id", "conversations": "conv_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows, _TEXT_KEYS[name]) if name in _TEXT_KEYS else rows


def conversation_posts(
    spark: SparkSession, folder: str, shape: str = "branching", brands: int = 5
) -> DataFrame:
    """Conversation turns as posts.

    ``branching`` hangs turn t below turn (t - 1) div 2, ``linear`` below turn t - 1. Assistant and
    system turns are written by one of a few brands, chosen by conversation.
    """
    c = table(spark, folder, "conversations")
    above = F.expr("(turn - 1) div 2") if shape == "branching" else F.col("turn") - 1
    inbound = F.col("role") == "user"
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("tweet_id"),
        F.when(inbound, F.concat(F.lit("user"), F.col("conv_id")))
        .otherwise(F.concat(F.lit("brand"), F.col("conv_id") % brands))
        .alias("author_id"),
        inbound.alias("inbound"),
        F.lit(None).cast("timestamp").alias("created_at"),
        "text",
        F.when(F.col("turn") != 0, F.col("conv_id") * 100 + above).alias("in_reply_to"),
    )


def previous_in_group(
    df: DataFrame, group: str, order: list[str], bucket: Column, value: str
) -> DataFrame:
    """``value`` of the previous row of a group, without holding a whole group in one task.

    Rows are ordered inside (group, bucket); the first row of a bucket takes the last value of the
    group's previous bucket from a table with one row per bucket.
    """
    rows = df.withColumn("_bucket", bucket)
    inner = W.partitionBy(group, "_bucket").orderBy(*order)
    rows = rows.withColumn("_prev", F.lag(value).over(inner))
    key = F.struct(*order)
    last = rows.groupBy(group, "_bucket").agg(F.max_by(value, key).alias("_last"))
    carried = last.withColumn(
        "_carry", F.lag("_last").over(W.partitionBy(group).orderBy("_bucket"))
    ).drop("_last")
    return (
        rows.join(carried, [group, "_bucket"])
        .withColumn(f"previous_{value}", F.coalesce("_prev", "_carry"))
        .drop("_bucket", "_prev", "_carry")
    )


def event_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as timed posts: each answers the user's previous event, a signup starts a thread.

    The text is made of the event's own columns; its type plays the agent signature.
    """
    events = table(spark, folder, "events")
    chained = previous_in_group(
        events, "user_id", ["ts", "event_id"], F.date_trunc("minute", "ts"), "event_id"
    )
    return chained.select(
        F.col("event_id").alias("tweet_id"),
        F.concat(F.lit("user"), F.col("user_id")).alias("author_id"),
        F.col("event_type").isin("click", "view", "error").alias("inbound"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.concat(
            F.lit("@user"), F.col("user_id"), F.lit(" "), F.col("event_type"), F.lit(" "),
            F.col("props"), F.lit(" ^"), F.upper(F.substring("event_type", 1, 2)),
        ).alias("text"),
        F.when(F.col("event_type") != "signup", F.col("previous_event_id")).alias("in_reply_to"),
    )


def document_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as outbound posts; the source plays the brand."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("tweet_id"),
        F.col("source").alias("author_id"),
        F.lit(False).alias("inbound"),
        "text",
    )


def knowledge(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as a knowledge base; a digest of the id picks one of six resolution levels."""
    digit = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 2), 16, 10).cast("int") % 6
    levels = F.array(*[F.lit(x) for x in (0.95, 0.75, 0.60, 0.40, 0.20, 0.10)])
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("kb_id"),
        F.col("text").alias("customer_inquiry"),
        F.col("source").alias("brand_reply"),
        F.element_at(levels, digit + 1).alias("resolution_score"),
    )


def gold(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a score from a digest: y = toxic, second rater = 1 - quality."""
    labels = table(spark, folder, "labels")
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    h = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("int")
    p = F.round((h % 1000) / F.lit(1000.0) * 0.6 + F.col("toxic") * 0.3, 3)
    return labels.join(docs, "doc_id").select(
        "doc_id",
        "text",
        "lang",
        "source",
        F.col("toxic").alias("y"),
        (1 - F.col("quality")).alias("y2"),
        p.alias("p"),
    )
