"""Ordered rule lists compiled to column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from replyloom import defaults as D
from replyloom.functions.text import word_count


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True where the text contains one of the words as a substring."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """True where one of the patterns is found, ignoring case."""
    return reduce(lambda a, b: a | b, [text.rlike(f"(?iU){p}") for p in patterns])


def first_rule(choices: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """Value of the first choice whose condition holds."""
    out = None
    for condition, value in choices:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return default if out is None else out.otherwise(default)


def canned_type(
    text: Column,
    dm: Sequence[str] = D.CANNED_DM,
    acknowledgement: Sequence[str] = D.CANNED_ACKNOWLEDGEMENT,
    dm_words: int = D.CANNED_DM_WORDS,
    acknowledgement_words: int = D.CANNED_ACKNOWLEDGEMENT_WORDS,
) -> Column:
    """Kind of a brand reply: pure or partial redirect, acknowledgement, or substantive."""
    words = word_count(text)
    redirect = matches_any(text, dm)
    return first_rule(
        [
            (redirect & (words <= dm_words), F.lit("pure_dm_deflection")),
            (redirect, F.lit("partial_dm_deflection")),
            (
                matches_any(text, acknowledgement) & (words <= acknowledgement_words),
                F.lit("generic_acknowledgment"),
            ),
        ],
        F.lit("substantive_contextual"),
    )


def is_canned(kind: Column) -> Column:
    """True for every kind of reply except the substantive one; null (no reply) is False."""
    return F.coalesce(kind != "substantive_contextual", F.lit(False))


def guardrail(
    text: Column, rules: Sequence[tuple[str, str]] = D.GUARDRAIL, group: int = 0
) -> Column:
    """Struct of the first matching safety category and the phrase found, or null."""
    return first_rule(
        [
            (
                text.rlike(pattern),
                F.struct(
                    F.lit(name).alias("category"),
                    F.regexp_extract(text, pattern, group).alias("phrase"),
                ),
            )
            for name, pattern in rules
        ],
        F.lit(None).cast("struct<category:string,phrase:string>"),
    )


def severity_tier(severity: Column, words: Sequence[str] = D.TIER0_SEVERITY) -> Column:
    """Mandatory-escalation tier for safety, legal or security severities, else tier 1."""
    return F.when(contains_any(severity, words), F.lit(D.TIER0_NAME)).otherwise(F.lit(D.TIER1_NAME))


def tag_intents(
    text: Column,
    keywords: Sequence[tuple[str, Sequence[str]]] = D.INTENT_KEYWORDS,
    whole_words: bool = False,
) -> Column:
    """Array of every intent one of whose keywords occurs (several labels are possible)."""
    low = F.lower(text)

    def hit(words: Sequence[str]) -> Column:
        if whole_words:
            either = "|".join(words)
            return low.rlike(rf"(^|[^\p{{L}}])({either})($|[^\p{{L}}])")
        return contains_any(low, words)

    labels = F.array(*[F.when(hit(words), F.lit(name)) for name, words in keywords])
    return F.filter(labels, lambda x: x.isNotNull())


def classify_inquiry(
    text: Column,
    rules: Sequence[tuple[Sequence[str], int, str, str]] = D.GOLD_RULES,
    negative: Sequence[str] = D.GOLD_NEGATIVE_WORDS,
    short_words: int = D.GOLD_SHORT_WORDS,
    question_mark: str = "?",
) -> Column:
    """Escalation, intent and rationale of an inquiry by ordered keyword rules."""
    low = F.lower(text)

    def verdict(escalate: int, intent: str, rationale: Column) -> Column:
        return F.struct(
            F.lit(escalate).alias("escalate"),
            F.lit(intent).alias("intent"),
            rationale.alias("rationale"),
        )

    choices = []
    for words, escalate, intent, rationale in rules:
        reason = F.lit(rationale)
        if "{}" in rationale:
            before, after = rationale.split("{}")
            found = F.filter(
                F.array(*[F.when(low.contains(w), F.lit(w)) for w in words]),
                lambda x: x.isNotNull(),
            )
            reason = F.concat(F.lit(before), F.array_join(found, ", "), F.lit(after))
        choices.append((contains_any(low, words), verdict(escalate, intent, reason)))
    short = (
        text.contains(question_mark)
        & (word_count(low) <= short_words)
        & ~contains_any(low, negative)
    )
    escalate, intent, rationale = D.GOLD_SHORT
    choices.append((short, verdict(escalate, intent, F.lit(rationale))))
    escalate, intent, rationale = D.GOLD_OPEN
    return first_rule(choices, verdict(escalate, intent, F.lit(rationale)))


def coarse_class(
    category: Column,
    classes: Sequence[tuple[str, Sequence[str]]] = D.COARSE_CLASSES,
    default: str = D.COARSE_DEFAULT,
) -> Column:
    """Coarse class of a category name; the first class with a matching substring wins."""
    name = F.upper(F.coalesce(F.nullif(category, F.lit("")), F.lit(default)))
    return first_rule([(contains_any(name, w), F.lit(c)) for c, w in classes], F.lit(default))


def keyword_router(
    text: Column,
    rules: Sequence[tuple[Sequence[str], str, str, bool]] = D.ROUTER_RULES,
    default: tuple[str, str, bool] = D.ROUTER_DEFAULT,
) -> Column:
    """Intent, drafted reply and escalation flag by ordered keyword groups."""
    low = F.lower(text)

    def route(intent: str, reply: str, escalate: bool) -> Column:
        return F.struct(
            F.lit(intent).alias("intent"),
            F.lit(reply).alias("reply"),
            F.lit(escalate).alias("escalate"),
        )

    return first_rule(
        [(contains_any(low, words), route(i, r, e)) for words, i, r, e in rules], route(*default)
    )


def template_reply(
    intent: Column,
    templates: Sequence[tuple[str, str]] = D.TEMPLATES,
    default_intent: str = D.TEMPLATE_DEFAULT_INTENT,
) -> Column:
    """Static reply of an intent, with the default intent's reply for unknown ones."""
    table = dict(templates)
    return first_rule(
        [(intent == name, F.lit(reply)) for name, reply in templates],
        F.lit(table[default_intent]),
    )
