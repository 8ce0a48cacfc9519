"""Samples, quotas, corrections and audits of labelled data."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom import defaults as D
from replyloom.functions.rules import classify_inquiry
from replyloom.functions.text import is_bare_numeric
from replyloom.operators.threads import substantive
from replyloom.runtime import first_per_group, running_sums, salted_join


def shuffle_key(id_col: str, seed: int) -> Column:
    """A digest of id and seed: the same order on any partitioning and in any engine."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def hash_sample(
    df: DataFrame, id_col: str, seed: int, n: int, ties: Sequence[str] = ()
) -> DataFrame:
    """Uniform sample of n rows without replacement, in shuffled order (a distributed top-n).

    Meant for n that fits one task. ``ties`` orders rows that share an id.
    """
    return df.orderBy(shuffle_key(id_col, seed), id_col, *ties).limit(n)


def audit_slice(
    gold: DataFrame, id_col: str = "id", pct: float = 0.20, seed: int = 99, least: int = 3
) -> DataFrame:
    """A share of the rows for blind relabelling: at least ``least``, at most all.

    The share grows with the table, so rows are ranked by range partitions instead of a top-n,
    which would gather them in one task.
    """
    total = gold.count()
    n = max(least, min(total, math.ceil(total * pct)))
    shuffled = gold.withColumn("_shuffled", shuffle_key(id_col, seed))
    ranked = running_sums(
        shuffled, [F.col("_shuffled"), F.col(id_col)], {"_rank": F.lit(1).cast("long")}
    )
    return ranked.where(F.col("_rank") <= n).drop("_rank", "_shuffled")


def first_n_per(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return first_per_group(df, key, order, n, order)


def unlabelled(candidates: DataFrame, labels: DataFrame, key: str = "thread_id") -> DataFrame:
    """Candidates whose key has no label yet."""
    known = labels.where(F.col(key).isNotNull()).select(key).distinct()
    # many paths of one root share a thread id
    return salted_join(candidates, known, [key], "left_anti").select(*candidates.columns)


def quota_sample(
    candidates: DataFrame,
    existing: DataFrame,
    target: int,
    label: str = "ground_truth_escalate",
    id_col: str = "thread_id",
    seed: int = 42,
    classes: Sequence[int] = (1, 0),
    ties: Sequence[str] = (),
) -> DataFrame:
    """Fill each class up to its equal share of ``target`` with shuffled candidates.

    A class needs at most its quota, so a class holding most of the data never meets in one task.
    """
    each = target // len(classes)
    have = existing.where(F.col(label).isin(*classes)).groupBy(label).agg(F.count(F.lit(1)).alias("_have"))
    shuffled = candidates.where(F.col(label).isin(*classes)).withColumn(
        "_shuffled", shuffle_key(id_col, seed)
    )
    ranked = first_per_group(
        shuffled, [label], ["_shuffled", id_col, *ties], each, [id_col, *ties]
    )
    # one row per class
    need = F.lit(each) - F.coalesce(F.col("_have"), F.lit(0))
    return (
        ranked.join(F.broadcast(have), label, "left")
        .where(F.col("rank") <= need)
        .drop("_shuffled", "_have")
    )


def renumber(
    df: DataFrame, order: Sequence[str], prefix: str = D.GOLD_PREFIX, width: int = 3,
    out: str = "id",
) -> DataFrame:
    """Ids prefix001, prefix002, ... in the given order, numbered without a global window."""
    numbered = running_sums(df, [F.col(c) for c in order], {"_n": F.lit(1).cast("long")})
    text = F.col("_n").cast("string")
    padded = F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))
    return numbered.withColumn(out, F.concat(F.lit(prefix), padded)).drop("_n")


def append_gold(existing: DataFrame, added: DataFrame) -> DataFrame:
    """New rows after the preserved ones."""
    return existing.unionByName(added, allowMissingColumns=True)


def pair_relabels(gold: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """First and second label of the same item and whether they agree.

    ``gold`` has (key, text, ground_truth_escalate), ``second`` (key, blind_relabel_escalate).
    """
    return (
        gold.select(key, "text", F.col("ground_truth_escalate").alias("original_escalate"))
        .join(second.select(key, "blind_relabel_escalate"), key)
        .withColumn(
            "is_consistent", F.col("original_escalate") == F.col("blind_relabel_escalate")
        )
    )


def apply_corrections(
    gold: DataFrame, corrections: DataFrame, stamp: Column | None = None, key: str = "id",
    order: str = "corrected_at",
) -> DataFrame:
    """Gold rows with corrected labels, intents and notes.

    Of several corrections of an id the last in ``order`` counts (without that column, the greatest
    by label, intent and note). A blank label or intent keeps the old one; a note of "-" clears it, a blank or number-like note
    keeps it. Rows with a correction get ``corrected_at``.
    """
    fields = ["ground_truth_escalate", "ground_truth_intent", "human_rationale"]
    place = F.struct(*[c for c in (order,) if c in corrections.columns], *fields)
    latest = corrections.groupBy(key).agg(F.max_by(F.struct(*fields), place).alias("_row"))
    new = latest.select(key, "_row.*").select(
        key,
        F.col("ground_truth_escalate").alias("_escalate"),
        F.nullif(F.trim("ground_truth_intent"), F.lit("")).alias("_intent"),
        F.trim("human_rationale").alias("_note"),
        F.lit(True).alias("_hit"),
    )
    note = (
        F.when(F.col("_note").isNull() | (F.col("_note") == ""), F.col("human_rationale"))
        .when(F.col("_note") == "-", F.lit(""))
        .when(is_bare_numeric(F.col("_note")), F.col("human_rationale"))
        .otherwise(F.col("_note"))
    )
    before = (
        F.col("corrected_at") if "corrected_at" in gold.columns else F.lit(None).cast("string")
    )
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss") if stamp is None else stamp
    return (
        gold.join(new, key, "left")
        .withColumns(
            {
                "ground_truth_escalate": F.coalesce("_escalate", "ground_truth_escalate"),
                "ground_truth_intent": F.coalesce("_intent", "ground_truth_intent"),
                "human_rationale": note,
                "corrected_at": F.when(F.col("_hit"), now).otherwise(before),
            }
        )
        .drop("_escalate", "_intent", "_note", "_hit")
    )


def validate_labels(
    df: DataFrame,
    note: str | None = "human_rationale",
    ratings: Sequence[str] = (),
    low: float = 1.0,
    high: float = 5.0,
) -> DataFrame:
    """Adds ``valid`` and ``problem``: number-like notes and ratings out of range are rejected."""
    problem = F.lit(None).cast("string")
    for name in reversed(ratings):
        value = F.col(name)
        out = value.isNull() | F.isnan(value) | (value < low) | (value > high)
        problem = F.when(out, F.lit(f"{name} out of range")).otherwise(problem)
    if note is not None:
        bare = F.coalesce(is_bare_numeric(F.col(note)), F.lit(False))
        problem = F.when(bare, F.lit(f"{note} looks like a number")).otherwise(problem)
    return df.withColumn("problem", problem).withColumn("valid", F.col("problem").isNull())


def label_candidates(
    threads: DataFrame, labels: DataFrame, n: int, seed: int = 42,
    min_words: int = 6, key: str = "thread_id",
) -> DataFrame:
    """n shuffled candidates for labelling: substantive threads that have no label yet."""
    ties = _leaf(threads)
    kept = substantive(
        threads, "customer_inquiry_text", "initial_brand_reply", min_words, min_words
    ).select(key, "customer_inquiry_text", "initial_brand_reply", "num_turns", *ties)
    return hash_sample(unlabelled(kept, labels, key), key, seed, n, ties).drop(*ties)


def _leaf(threads: DataFrame) -> list[str]:
    """The column that tells threads of one root apart, if present."""
    return [c for c in ("leaf_tweet_id",) if c in threads.columns]


def balance_gold(
    threads: DataFrame,
    existing: DataFrame,
    target: int = 160,
    seed: int = 42,
    labelled_at: Column | None = None,
    rules=D.GOLD_RULES,
    question_mark: str = "?",
    min_words: int = 6,
) -> DataFrame:
    """Gold set topped up to equal classes with rule-labelled threads, ids renumbered.

    Preserved rows come first, then new escalations, then new self-service rows.
    """
    fresh = unlabelled(
        substantive(
            threads, "customer_inquiry_text", "initial_brand_reply", min_words, min_words
        ),
        existing,
    )
    verdict = classify_inquiry(F.col("text"), rules, question_mark=question_mark)
    now = (
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
        if labelled_at is None
        else labelled_at
    )
    ties = _leaf(threads)
    candidates = fresh.select(
        "thread_id",
        F.trim("customer_inquiry_text").alias("text"),
        F.trim("initial_brand_reply").alias("actual_historical_reply"),
        *ties,
    ).withColumn("_v", verdict).select(
        "thread_id", "text", "actual_historical_reply", *ties,
        F.col("_v.escalate").alias("ground_truth_escalate"),
        F.col("_v.intent").alias("ground_truth_intent"),
        F.col("_v.rationale").alias("human_rationale"),
        now.alias("labeled_at"),
    )
    added = quota_sample(candidates, existing, target, seed=seed, ties=ties)
    columns = [
        "thread_id", "text", "actual_historical_reply", "ground_truth_escalate",
        "ground_truth_intent", "human_rationale", "labeled_at",
    ]
    kept = existing.select(
        *columns, F.lit(0).alias("_group"), F.col("id").alias("_place")
    )
    new = added.select(
        *columns,
        F.when(F.col("ground_truth_escalate") == 1, F.lit(1)).otherwise(F.lit(2)).alias("_group"),
        F.lpad(F.col("rank").cast("string"), 12, "0").alias("_place"),
    )
    return renumber(append_gold(kept, new), ["_group", "_place", "thread_id"]).drop(
        "_group", "_place"
    )


def showcase(threads: DataFrame, n: int = 2) -> DataFrame:
    """The first n threads of each flag, and of those with a booking code and a flight masked."""
    flags = F.col("metadata.flags")
    said = F.array_join(F.transform("turns", lambda t: t["scrubbed_text"]), "\n")
    both = said.contains(D.TOKEN_BOOKING) & said.contains(D.FLIGHT_PREFIX)
    named = F.filter(
        F.array(
            F.when(flags["multi_agent_handoff"], F.lit("multi_agent_handoff")),
            F.when(flags["temporal_gap_gt_24h"], F.lit("temporal_gap_gt_24h")),
            F.when(flags["is_pure_canned_deflection"], F.lit("canned_deflection")),
            F.when(both, F.lit("pii_scrubbed_pnr_flight")),
        ),
        lambda x: x.isNotNull(),
    )
    return first_n_per(
        threads.withColumn("category", F.explode(named)),
        ["category"], ["root_tweet_id", "leaf_tweet_id"], n,
    )
