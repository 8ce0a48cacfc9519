"""How a thread was resolved, and the knowledge base built from that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom import defaults as D
from replyloom.functions.rules import first_rule
from replyloom.functions.text import word_count
from replyloom.operators.threads import substantive, turns_after_brand


def resolution(
    turns: Column,
    pure_canned: Column,
    handoff: Column | None = None,
    gratitude: str = D.GRATITUDE,
    frustration: str = D.FRUSTRATION,
    reply_words: int = D.SUBSTANTIVE_REPLY_WORDS,
) -> Column:
    """Score, label, rationale and signals of a thread, from its turn array alone.

    The order of the cases matters: a purely canned thread is never looked into, and anger beats
    thanks.
    """
    first = F.try_element_at(F.filter(turns, lambda t: t["speaker"] == "brand"), F.lit(1))
    later = turns_after_brand(turns)
    thanked = F.exists(later, lambda t: t["scrubbed_text"].rlike(gratitude))
    angry = F.exists(later, lambda t: t["scrubbed_text"].rlike(frustration))
    answered = (word_count(first["scrubbed_text"]) >= reply_words) & ~first["is_canned"]
    cases = [
        (pure_canned, "deflected"),
        (first.isNull(), "no_reply"),
        (thanked & ~angry, "thanked"),
        (angry, "angry"),
        ((F.size(later) == 0) & answered, "closed"),
        (F.size(later) == 0, "silent"),
    ]

    def part(i: int) -> Column:
        return first_rule(
            [(c, F.lit(D.RESOLUTION[name][i])) for c, name in cases],
            F.lit(D.RESOLUTION["continued"][i]),
        )

    looked_at = ~pure_canned & first.isNotNull()
    signals = F.struct(
        F.when(looked_at, thanked).otherwise(F.lit(False)).alias("has_gratitude"),
        F.when(looked_at, angry).otherwise(F.lit(False)).alias("has_frustration"),
        F.when(looked_at, F.size(later)).alias("subsequent_turns_count"),
        F.when(looked_at, F.lit(False) if handoff is None else handoff).alias(
            "multi_agent_handoff"
        ),
    )
    return F.struct(
        part(0).alias("resolution_score"),
        part(1).alias("resolution_label"),
        part(2).alias("rationale"),
        signals.alias("signals"),
    )


def label_resolution(threads: DataFrame, **patterns) -> DataFrame:
    """Threads with a ``resolution`` struct."""
    flags = F.col("metadata.flags")
    return threads.withColumn(
        "resolution",
        resolution(
            F.col("turns"),
            F.coalesce(flags["is_pure_canned_deflection"], F.lit(False)),
            F.coalesce(flags["multi_agent_handoff"], F.lit(False)),
            **patterns,
        ),
    )


def build_kb(
    threads: DataFrame, min_query: int = 4, min_reply: int = 5, **patterns
) -> DataFrame:
    """Knowledge base: question, answer and how well the answer worked.

    ``kb_id`` is the leaf of the thread: several paths of one root share a thread id.
    """
    kept = substantive(
        threads, "customer_inquiry_text", "initial_brand_reply", min_query, min_reply
    )
    return label_resolution(kept, **patterns).select(
        F.col("leaf_tweet_id").alias("kb_id"),
        "thread_id",
        F.col("customer_inquiry_text").alias("customer_inquiry"),
        F.col("initial_brand_reply").alias("brand_reply"),
        "resolution.resolution_score",
        "resolution.resolution_label",
        "resolution.rationale",
    )


def label_distribution(kb: DataFrame) -> DataFrame:
    """Rows and share of each resolution label."""
    total = kb.agg(F.count(F.lit(1)))
    return (
        kb.groupBy("resolution_label")
        .agg(F.count(F.lit(1)).alias("pairs"))
        .withColumn("pct", F.col("pairs") / total.scalar() * 100)
    )


def resolve_turns(
    turns: DataFrame,
    keys: list[str],
    gratitude: str = D.GRATITUDE,
    frustration: str = D.FRUSTRATION,
    reply_words: int = D.SUBSTANTIVE_REPLY_WORDS,
) -> DataFrame:
    """Resolution score and label from turn rows, without building any turn array.

    A signal comes after the first brand turn exactly when its last occurrence does, so a few
    combinable aggregates per thread are enough, however long a thread is.
    """
    i, text = F.col("turn_index"), F.col("scrubbed_text")
    brand, customer = F.col("speaker") == "brand", F.col("speaker") == "customer"
    first = F.min(F.when(brand, F.struct(i, word_count(text).alias("words"), "is_canned")))
    seen = turns.groupBy(*keys).agg(
        first.alias("_first"),
        F.max(F.when(customer, i)).alias("_last"),
        F.max(F.when(customer & text.rlike(gratitude), i)).alias("_thanks"),
        F.max(F.when(customer & text.rlike(frustration), i)).alias("_anger"),
        ((F.count_if("is_canned") == F.count_if(brand)) & (F.count_if(brand) > 0)).alias("_canned"),
    )

    def after(name: str) -> Column:
        return F.coalesce(F.col(name) > F.col("_first.turn_index"), F.lit(False))

    answered = (F.col("_first.words") >= reply_words) & ~F.col("_first.is_canned")
    cases = [
        (F.col("_canned"), "deflected"),
        (F.col("_first").isNull(), "no_reply"),
        (after("_thanks") & ~after("_anger"), "thanked"),
        (after("_anger"), "angry"),
        (~after("_last") & answered, "closed"),
        (~after("_last"), "silent"),
    ]
    return seen.select(
        *keys,
        *[
            first_rule(
                [(c, F.lit(D.RESOLUTION[n][p])) for c, n in cases],
                F.lit(D.RESOLUTION["continued"][p]),
            ).alias(name)
            for p, name in ((0, "resolution_score"), (1, "resolution_label"))
        ],
    )
