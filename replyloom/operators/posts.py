"""Flat posts: selection, ids, deduplication, brand corpora and brand volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom import defaults as D


def brand_posts(posts: DataFrame, brands: Sequence[str] = D.PROFILE_BRANDS) -> DataFrame:
    """Posts written by one of the brands; names are case-sensitive."""
    return posts.where(F.col("author_id").isin(*brands))


def outbound(posts: DataFrame) -> DataFrame:
    """Posts sent by a brand account."""
    return posts.where(~F.col("inbound"))


def normalise_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Ids that arrive as text or floating point become nullable longs; 0 stays a valid id."""

    def as_id(name: str):
        number = F.expr(f"try_cast(`{name}` as double)")
        whole = F.expr(f"try_cast(`{name}` as bigint)")
        return F.coalesce(whole, F.when(~F.isnan(number), number).try_cast("bigint"))

    return df.withColumns({c: as_id(c) for c in columns})


def dedupe_posts(df: DataFrame, order_col: str, key: str = "tweet_id") -> DataFrame:
    """One row per id: the one that comes last in ``order_col``."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, order_col).alias("_row")).select("_row.*")


def unique_posts(df: DataFrame, order_col: str | None = None, key: str = "tweet_id") -> DataFrame:
    """``df`` with one row per id, checked by a count of the ids.

    Of rows that repeat an id the last in ``order_col`` stays; without it the last by time and
    content, so the choice does not depend on partitioning.
    """
    if df.groupBy(key).count().where(F.col("count") > 1).isEmpty():
        return df
    if order_col is not None:
        return dedupe_posts(df, order_col, key)
    place = F.struct(*[c for c in ("created_at",) if c in df.columns], F.xxhash64(*df.columns))
    return dedupe_posts(df.withColumn("_place", place), "_place", key).drop("_place")


def needed_parents(replies: DataFrame) -> DataFrame:
    """Distinct ids that the given posts reply to, over all brands."""
    return (
        replies.where(F.col("in_reply_to").isNotNull())
        .select(F.col("in_reply_to").alias("tweet_id"))
        .distinct()
    )


def parents_of(posts: DataFrame, replies: DataFrame) -> DataFrame:
    """Posts that at least one of ``replies`` answers."""
    return posts.join(needed_parents(replies), "tweet_id", "left_semi")


def brand_corpus(posts: DataFrame, brands: Sequence[str] = D.PROFILE_BRANDS) -> DataFrame:
    """For each brand its own posts plus every post it replied to, keyed by (brand, tweet_id).

    A post answered by several brands appears once for each of them. The pairs (brand, parent)
    are made distinct before the join, so a parent meets at most one row per brand.
    """
    posts = unique_posts(posts)
    own = brand_posts(posts, brands).select(F.col("author_id").alias("brand"), *posts.columns)
    pairs = (
        own.where(F.col("in_reply_to").isNotNull())
        .select("brand", F.col("in_reply_to").alias("tweet_id"))
        .distinct()
    )
    answered = posts.join(pairs, "tweet_id").where(F.col("author_id") != F.col("brand"))
    own = own.withColumn("inbound", F.lit(False))
    return own.unionByName(answered.select("brand", *posts.columns))


def brand_volume(posts: DataFrame, k: int = 15) -> DataFrame:
    """The k brands with the most outbound posts, with the size of the whole table."""
    total = posts.agg(F.count(F.lit(1)))
    return (
        outbound(posts)
        .groupBy(F.col("author_id").alias("brand"))
        .agg(F.count(F.lit(1)).alias("replies"))
        .orderBy(F.desc("replies"), "brand")
        .limit(k)
        .withColumn("total_posts", total.scalar())
    )
