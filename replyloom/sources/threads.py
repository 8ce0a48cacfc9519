"""Thread files: JSON lines, JSON arrays, samples and data gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from replyloom.schemas import TAXONOMY, THREAD
from replyloom.sources.split_records import read_json_elements


def read_threads(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Thread file with one JSON object per line; blank lines are skipped."""
    threads = spark.read.schema(THREAD).json(path)
    if max_rows is not None:
        threads = compact_sample(threads, ["root_tweet_id", "leaf_tweet_id", "thread_id"], max_rows)
    return threads


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Files holding one JSON array of objects each; large ones are read by many tasks."""
    return read_json_elements(spark, path, schema)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Nested taxonomy file as (tier, intent, sub_intent, override, action_policy)."""
    return taxonomy_table(spark.read.text(path, wholetext=True), "value", TAXONOMY)


def taxonomy_table(df: DataFrame, column: str, schema: DataType = TAXONOMY) -> DataFrame:
    """Rows of a taxonomy held as JSON text; an intent without sub-intents gives one row."""
    return (
        df.select(F.from_json(column, schema).alias("tiers"))
        .select(F.explode("tiers").alias("tier", "intents"))
        .select("tier", F.explode("intents").alias("intent", "policy"))
        .select(
            "tier",
            "intent",
            F.explode_outer("policy.sub_intents").alias("sub_intent"),
            F.coalesce("policy.override", F.lit(False)).alias("override"),
            F.col("policy.action_policy").alias("action_policy"),
        )
    )


def compact_sample(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """The first n rows in the order of the key columns, the same on any partitioning."""
    return df.orderBy(*key).limit(n)


def write_threads(
    threads: DataFrame, path: str, sample_path: str | None = None, n: int = 5000
) -> None:
    """Write threads as JSON lines and, if asked, a sample of the first n."""
    threads.write.mode("overwrite").json(path)
    if sample_path is not None:
        written = threads.sparkSession.read.schema(threads.schema).json(path)
        sample = compact_sample(written, ["root_tweet_id", "leaf_tweet_id"], n)
        sample.write.mode("overwrite").json(sample_path)


def convert_json_to_jsonl(
    spark: SparkSession, source: str, target: str, cap: int | None = None,
    schema: StructType = THREAD, order: Sequence[str] = ("root_tweet_id", "leaf_tweet_id"),
) -> None:
    """Turn a JSON array into JSON lines, dropping what cannot be parsed.

    All rows are written, or the first ``cap`` in the given order.
    """
    rows = read_json_elements(spark, source, schema)
    if cap is not None:
        rows = rows.orderBy(*order).limit(cap)
    rows.write.mode("overwrite").json(target)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a result table as ``json`` or ``csv``."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown report format {fmt!r}")


def require(
    df: DataFrame, min_rows: int, class_col: str | None = None, min_classes: int = 2
) -> DataFrame:
    """Return ``df`` unchanged, or fail when it has too few rows or classes."""
    checks = [F.count(F.lit(1)).alias("rows")]
    if class_col is not None:
        checks.append(F.count_distinct(class_col).alias("classes"))
    found = df.agg(*checks).first()
    if found["rows"] < min_rows:
        raise ValueError(f"{found['rows']} rows, at least {min_rows} are needed")
    if class_col is not None and found["classes"] < min_classes:
        raise ValueError(
            f"{found['classes']} classes in {class_col}, at least {min_classes} are needed"
        )
    return df
