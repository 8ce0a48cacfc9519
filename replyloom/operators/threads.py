"""Turns, gaps, flags and assembled threads."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom import defaults as D
from replyloom.functions.privacy import MaskRules, mask_steps, scrub
from replyloom.functions.rules import canned_type, is_canned
from replyloom.functions.text import round_half_up, split_signature, word_count
from replyloom.operators.graph import path_members, thread_leaves
from replyloom.operators.posts import unique_posts
from replyloom.runtime import materialize, salted_join


@dataclass(frozen=True)
class ThreadRules:
    """Parameters of thread building; ``canned`` are keyword arguments of ``canned_type``."""

    mask: MaskRules = MaskRules()
    signature: str = D.TRAILING_SIGNATURE
    canned: Mapping[str, object] = field(default_factory=dict)
    thread_prefix: str = "delta_thread_"
    gap_hours: float = 24.0


def post_facts(posts: DataFrame, rules: ThreadRules = ThreadRules()) -> DataFrame:
    """What a turn needs to know about a post, computed once per post and not once per path.

    Signatures and canned replies are looked for in brand posts only, and the canned type is
    decided on the raw text.
    """
    brand = ~F.col("inbound")
    cut = split_signature(F.col("text"), rules.signature)
    kind = F.when(brand, canned_type(F.col("text"), **rules.canned))
    return posts.withColumn("_cut", F.when(brand, cut)).select(
        "tweet_id",
        F.when(brand, F.lit("brand")).otherwise(F.lit("customer")).alias("speaker"),
        F.col("_cut.signature").alias("signature"),
        scrub(F.when(brand, F.col("_cut.rest")).otherwise(F.col("text")), rules.mask).alias(
            "scrubbed_text"
        ),
        kind.alias("macro_type"),
        is_canned(kind).alias("is_canned"),
    )


def turn_gaps(posts: DataFrame) -> DataFrame:
    """Hours between a post and the post it answers: (tweet_id, gap_from_prev_hours, has_gap).

    The turn before a post in any path is its parent, so one join per post replaces a window per
    path. A missing time on either side gives 0.
    """
    child = posts.select("tweet_id", F.col("in_reply_to").alias("_parent"), "created_at")
    parent = posts.select(F.col("tweet_id").alias("_parent"), F.col("created_at").alias("_before"))
    seconds = (F.unix_micros("created_at") - F.unix_micros("_before")) / F.lit(1e6)
    later = F.when(seconds > 0, seconds).when(seconds.isNotNull(), F.lit(0.0))
    hours = round_half_up(later / F.lit(3600.0), 2)
    return salted_join(child, parent, ["_parent"], "left", spread=["tweet_id"]).select(
        "tweet_id",
        F.coalesce(hours, F.lit(0.0)).alias("gap_from_prev_hours"),
        hours.isNotNull().alias("has_gap"),
    )


def thread_turns(posts: DataFrame, rules: ThreadRules = ThreadRules()) -> DataFrame:
    """One row per turn of every root-to-leaf path. Repeated ids count once (``unique_posts``)."""
    posts = unique_posts(posts)
    # the reply columns are read in every round, the texts only once
    links = materialize(posts.select("tweet_id", "in_reply_to", "created_at"), "links")
    facts = materialize(
        post_facts(posts, rules).join(turn_gaps(links), "tweet_id"), "facts"
    )
    members = path_members(links)
    return salted_join(members, facts, ["tweet_id"], spread=["leaf_id"]).select(
        F.col("root_id").alias("root_tweet_id"),
        F.col("leaf_id").alias("leaf_tweet_id"),
        F.col("depth").cast("int").alias("num_turns"),
        F.col("position").alias("turn_index"),
        "tweet_id", "speaker", "signature", "scrubbed_text", "is_canned", "macro_type",
        "gap_from_prev_hours", "has_gap",
    )


def assemble_threads(turns: DataFrame, rules: ThreadRules = ThreadRules()) -> DataFrame:
    """Nested threads with at least two turns and a brand turn.

    The collected array is one path, which is the row the caller asks for; use ``thread_flags``
    where only the flags are needed.
    """
    turn = F.struct(
        "turn_index", "tweet_id", "speaker", "scrubbed_text", "is_canned", "macro_type",
        "gap_from_prev_hours",
    )
    brand = F.col("speaker") == "brand"
    grouped = (
        turns.where(F.col("num_turns") >= 2)
        .groupBy("root_tweet_id", "leaf_tweet_id", "num_turns")
        .agg(
            F.array_sort(F.collect_list(turn)).alias("turns"),
            F.array_sort(F.collect_set("signature")).alias("agent_signatures"),
            F.count_if(brand).alias("_brand"),
            F.count_if("is_canned").alias("_canned"),
            F.max(F.when(F.col("has_gap"), F.col("gap_from_prev_hours"))).alias("_gap"),
        )
        .where(F.col("_brand") > 0)
    )
    flags = F.struct(
        (F.size("agent_signatures") >= 2).alias("multi_agent_handoff"),
        F.coalesce(F.col("_gap") >= rules.gap_hours, F.lit(False)).alias("temporal_gap_gt_24h"),
        (F.col("_canned") == F.col("_brand")).alias("is_pure_canned_deflection"),
    )
    heads = thread_heads(F.col("turns"))
    return grouped.select(
        F.concat(F.lit(rules.thread_prefix), F.col("root_tweet_id")).alias("thread_id"),
        "root_tweet_id",
        "leaf_tweet_id",
        "num_turns",
        heads["customer_inquiry_text"].alias("customer_inquiry_text"),
        heads["initial_brand_reply"].alias("initial_brand_reply"),
        "turns",
        F.struct("agent_signatures", flags.alias("flags")).alias("metadata"),
    )


def reconstruct_threads(
    posts: DataFrame, rules: ThreadRules = ThreadRules()
) -> DataFrame:
    """Threads of a post table: paths, turns, masking, flags."""
    return assemble_threads(thread_turns(posts, rules), rules)


def thread_heads(turns: Column) -> Column:
    """Text of the first turn, whoever wrote it, and of the first brand turn ("" if none)."""
    brand = F.filter(turns, lambda t: t["speaker"] == "brand")
    return F.struct(
        F.try_element_at(turns, F.lit(1))["scrubbed_text"].alias("customer_inquiry_text"),
        F.coalesce(F.try_element_at(brand, F.lit(1))["scrubbed_text"], F.lit("")).alias(
            "initial_brand_reply"
        ),
    )


def first_customer_turn(threads: DataFrame, min_words: int = 4) -> DataFrame:
    """Threads with the text of their first customer turn, if it has enough words."""
    said = F.filter("turns", lambda t: t["speaker"] == "customer")
    return threads.withColumn(
        "inquiry", F.try_element_at(said, F.lit(1))["scrubbed_text"]
    ).where(F.col("inquiry").isNotNull() & (word_count(F.col("inquiry")) >= min_words))


def substantive(
    df: DataFrame, query: str, reply: str | None, min_query: int, min_reply: int = 0
) -> DataFrame:
    """Rows whose query, and reply if given, have at least the given numbers of words."""
    keep = word_count(F.col(query)) >= min_query
    if reply is not None:
        keep = keep & (word_count(F.col(reply)) >= min_reply)
    return df.where(keep)


def turns_after_brand(turns: Column) -> Column:
    """Customer turns that follow the first brand turn of a thread."""
    first = F.array_position(F.transform(turns, lambda t: t["speaker"]), "brand")
    later = F.filter(
        turns, lambda t, i: (first > 0) & (i >= first) & (t["speaker"] == "customer")
    )
    return later


def thread_flags(
    posts: DataFrame,
    rules: ThreadRules = ThreadRules(),
    extra: Mapping[str, tuple[Column, str]] | None = None,
) -> DataFrame:
    """Flags and counts of every thread without building any turn array.

    Two distinct signatures exist exactly where the least and the greatest differ, so all flags
    fold along the reply pointers in constant space per post. ``extra`` adds further measures over
    columns of ``posts``.
    """
    extra = dict(extra or {})
    # written first: the check of ids, the gaps and the texts would each build the posts anew
    posts = unique_posts(materialize(posts, "posts"))
    brand = ~F.col("inbound")
    links = materialize(posts.select("tweet_id", "in_reply_to", "created_at"), "links")
    prepared = posts.join(turn_gaps(links), "tweet_id").withColumns(
        {
            "_sig": F.when(brand, split_signature(F.col("text"), rules.signature)["signature"]),
            "_canned": (
                brand & is_canned(canned_type(F.col("text"), **rules.canned))
            ).cast("long"),
            "_brand": brand.cast("long"),
            "_gap": F.when(F.col("has_gap"), F.col("gap_from_prev_hours")),
        }
    )
    leaves = thread_leaves(
        prepared,
        measures={
            "low_signature": (F.col("_sig"), "min"),
            "high_signature": (F.col("_sig"), "max"),
            "canned_turns": (F.col("_canned"), "sum"),
            "brand_turns": (F.col("_brand"), "sum"),
            "max_gap_hours": (F.col("_gap"), "max"),
            **extra,
        },
    ).where((F.col("brand_turns") > 0) & (F.col("depth") >= 2))
    differs = F.col("low_signature") != F.col("high_signature")
    return leaves.select(
        F.col("root_id").alias("root_tweet_id"),
        F.col("leaf_id").alias("leaf_tweet_id"),
        F.col("depth").cast("int").alias("num_turns"),
        "brand_turns",
        "canned_turns",
        "max_gap_hours",
        F.coalesce(differs, F.lit(False)).alias("multi_agent_handoff"),
        F.coalesce(F.col("max_gap_hours") >= rules.gap_hours, F.lit(False)).alias(
            "temporal_gap_gt_24h"
        ),
        (F.col("canned_turns") == F.col("brand_turns")).alias("is_pure_canned_deflection"),
        *extra,
    )


ENTITY_KINDS = ("urls", "handles", "pnrs", "flights", "phones", "cards")


def cleaning_summary(posts: DataFrame, rules: ThreadRules = ThreadRules()) -> DataFrame:
    """One row: threads, handoffs, gaps, canned and branching threads, masked entities by kind.

    Entities are counted over the turns of all threads.
    """
    brand = ~F.col("inbound")
    rest = split_signature(F.col("text"), rules.signature)["rest"]
    counts = mask_steps(F.when(brand, rest).otherwise(F.col("text")), rules.mask)[1]
    counted = posts.withColumns({f"n_{k}": counts[k].cast("long") for k in ENTITY_KINDS})
    threads = materialize(
        thread_flags(
            counted, rules, {f"n_{k}": (F.col(f"n_{k}"), "sum") for k in ENTITY_KINDS}
        ),
        "flags",
    )
    branching = threads.groupBy("root_tweet_id").agg(F.count(F.lit(1)).alias("n"))
    return threads.agg(
        F.count(F.lit(1)).alias("total_threads"),
        F.count_if("multi_agent_handoff").alias("multi_agent_handoffs"),
        F.count_if("temporal_gap_gt_24h").alias("temporal_gap_gt_24h"),
        F.count_if(F.col("max_gap_hours") >= 2 * rules.gap_hours).alias("temporal_gap_gt_48h"),
        F.count_if(F.col("canned_turns") > 0).alias("contains_canned_macros"),
        F.count_if("is_pure_canned_deflection").alias("pure_canned_deflection_threads"),
        *[F.coalesce(F.sum(f"n_{k}"), F.lit(0)).alias(k) for k in ENTITY_KINDS],
    ).withColumn(
        "branching_threads",
        branching.agg(F.count_if(F.col("n") > 1)).scalar(),
    )
