"""Post files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.functions.text import parse_post_time
from replyloom.operators.posts import normalise_ids
from replyloom.schemas import POST_CSV
from replyloom.sources.split_records import read_csv_records


def read_posts(
    spark: SparkSession, path: str | Sequence[str], multi_line: bool = True
) -> DataFrame:
    """Post CSV with quoted fields that may span lines, read by as many tasks as its bytes give.

    Set ``multi_line=False`` where no field spans lines: that saves the scan for open quotes.
    """
    if multi_line:
        raw = read_csv_records(spark, path, POST_CSV)
    else:
        raw = (
            spark.read.schema(POST_CSV)
            .option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .csv(path)
        )
    ids = F.filter(F.split("response_tweet_id", r"\s*,\s*"), lambda x: x != "")
    return normalise_ids(raw, "in_response_to_tweet_id").select(
        "tweet_id",
        "author_id",
        (F.lower(F.trim("inbound")) == "true").alias("inbound"),
        parse_post_time(F.col("created_at")).alias("created_at"),
        "text",
        F.col("in_response_to_tweet_id").alias("in_reply_to"),
        F.transform(ids, lambda x: x.try_cast("bigint")).alias("response_ids"),
    )


def read_post_table(spark: SparkSession, path: str) -> DataFrame:
    """Posts already stored as Parquet."""
    return spark.read.parquet(path)
