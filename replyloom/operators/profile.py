"""Brand profiles: volume, deflection, wording, signatures, depth and handoffs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom import defaults as D
from replyloom.functions.text import latin_words, profile_signatures
from replyloom.operators.graph import depth_stats, thread_leaves
from replyloom.operators.posts import brand_corpus
from replyloom.runtime import materialize


def deflection_rate(
    df: DataFrame, by: Sequence[str], pattern: str = D.PROFILE_DEFLECTION, text: str = "text"
) -> DataFrame:
    """Texts per group and the share that redirects to a private channel."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("texts"),
        F.coalesce(F.avg(F.col(text).rlike(pattern).cast("int")), F.lit(0.0)).alias(
            "deflection_rate"
        ),
    )


def distinct_n(df: DataFrame, by: Sequence[str], n: int, text: str = "text") -> DataFrame:
    """Unique over total words (n = 1) or bigrams (n = 2); bigrams never cross texts.

    Occurrences are first counted per (group, gram), so a frequent group or gram is combined
    before the shuffle and spread over all tasks by the gram.
    """
    if n not in (1, 2):
        raise ValueError("n must be 1 or 2")
    words, keys = F.col("_words"), [f"_gram{i}" for i in range(n)]
    size = F.greatest(F.size(words) - (n - 1), F.lit(0))
    # the words of a gram stay columns of their own, so that no gram is built by a function of one element
    grams = F.arrays_zip(*[F.slice(words, F.lit(i + 1), size).alias(key) for i, key in enumerate(keys)])
    return (
        df.select(*by, latin_words(F.col(text)).alias("_words"))
        # inline, unlike explode, adds no size filter that would tokenise the text twice
        .select(*by, F.inline(grams).alias(*keys))
        .groupBy(*by, *keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("unique_grams"), F.sum("_n").alias("total_grams"))
        .withColumn("distinct_ratio", F.col("unique_grams") / F.col("total_grams"))
    )


def signature_counts(
    df: DataFrame, by: Sequence[str], pattern: str = D.PROFILE_SIGNATURE, text: str = "text"
) -> DataFrame:
    """Number of different agent signatures per group."""
    return (
        df.select(*by, F.explode(profile_signatures(F.col(text), pattern)).alias("signature"))
        .distinct()
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("unique_agent_sigs"))
    )


def handoff_rate(leaves: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Roots with a path of two or more agents, as a share of paths.

    Needs the measures ``low_signature`` and ``high_signature`` of each path.
    """
    by = list(by)
    handed = F.coalesce(F.col("low_signature") != F.col("high_signature"), F.lit(False))
    return (
        leaves.groupBy(*by, "root_id")
        .agg(F.count(F.lit(1)).alias("paths"), F.max(handed).alias("handed"))
        .groupBy(*by)
        .agg(
            F.count_if("handed").alias("handoff_threads"),
            (F.count_if("handed") / F.sum("paths") * 100).alias("handoff_threads_pct"),
        )
    )


def corpus_leaves(corpus: DataFrame, signature: str = D.PROFILE_SIGNATURE) -> DataFrame:
    """Paths of every brand with the least and greatest first signature met on them."""
    first = F.try_element_at(profile_signatures(F.col("text"), signature), F.lit(1))
    signed = corpus.withColumn("_sig", F.when(~F.col("inbound"), first))
    return thread_leaves(
        signed,
        scope=["brand"],
        measures={
            "low_signature": (F.col("_sig"), "min"),
            "high_signature": (F.col("_sig"), "max"),
        },
    )


def profile_brands(
    posts: DataFrame,
    brands: Sequence[str] = D.PROFILE_BRANDS,
    deflection: str = D.PROFILE_DEFLECTION,
    signature: str = D.PROFILE_SIGNATURE,
) -> DataFrame:
    """Eleven measures per brand, zeros for a brand without posts.

    The joined tables hold one row per brand.
    """
    corpus = materialize(brand_corpus(posts, brands), "corpus")
    leaves = materialize(corpus_leaves(corpus, signature), "leaves")
    sent = corpus.where(~F.col("inbound"))
    parts = [
        sent.groupBy("brand").agg(
            F.count(F.lit(1)).alias("outbound_replies"),
            (F.avg(F.col("text").rlike(deflection).cast("int")) * 100).alias(
                "dm_deflection_rate_pct"
            ),
        ),
        depth_stats(leaves, ["brand"]),
        distinct_n(sent, ["brand"], 2).select(
            "brand", F.col("distinct_ratio").alias("distinct_2_bigram_ratio")
        ),
        signature_counts(sent, ["brand"], signature),
        handoff_rate(leaves, ["brand"]),
    ]
    names = posts.sparkSession.createDataFrame([(b,) for b in brands], "brand string")
    joined = reduce(lambda a, b: a.join(b, "brand", "left"), parts, names)
    zero = F.lit(0)
    return joined.select(
        "brand",
        *[
            F.coalesce(c, zero).alias(name)
            for c, name in (
                (F.col("outbound_replies"), "outbound_replies"),
                (F.col("paths"), "reconstructed_threads"),
                (F.round("avg_depth", 2), "avg_thread_depth"),
                (F.round("median_depth", 1), "median_thread_depth"),
                (F.col("max_depth"), "max_thread_depth"),
                (F.round("pct_depth_ge_3", 2), "pct_depth_ge_3"),
                (F.round("pct_depth_ge_4", 2), "pct_depth_ge_4"),
                (F.round("dm_deflection_rate_pct", 2), "dm_deflection_rate_pct"),
                (F.round("distinct_2_bigram_ratio", 4), "distinct_2_bigram_ratio"),
                (F.col("unique_agent_sigs"), "unique_agent_sigs"),
                (F.round("handoff_threads_pct", 2), "handoff_threads_pct"),
            )
        ],
    )
