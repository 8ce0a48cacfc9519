"""Rule-based reply rubric, score tiers and agreement bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from replyloom import defaults as D
from replyloom.functions.rules import contains_any, first_rule
from replyloom.functions.text import word_count


@dataclass(frozen=True)
class RubricWords:
    """Word lists of the rubric. ``action`` and ``address`` are case-sensitive."""

    emergency: Sequence[str] = D.RUBRIC_EMERGENCY
    escalated: Sequence[str] = D.RUBRIC_ESCALATED
    safe: Sequence[str] = D.RUBRIC_SAFE
    overpromise: Sequence[str] = D.RUBRIC_OVERPROMISE
    address: Sequence[str] = D.RUBRIC_ADDRESS
    channel: Sequence[str] = D.RUBRIC_CHANNEL
    action: Sequence[str] = D.RUBRIC_ACTION
    kind: Sequence[str] = D.RUBRIC_KIND
    penalty_words: int = D.PENALTY_WORDS


def weighted_score(scores: Mapping[str, Column]) -> Column:
    """Weighted sum of the four rubric scores, not rounded."""
    w = D.RUBRIC_WEIGHTS
    return (
        scores["safety_compliance"] * F.lit(w["safety_compliance"])
        + scores["factual_grounding"] * F.lit(w["factual_grounding"])
        + scores["actionability"] * F.lit(w["actionability"])
        + scores["tone_empathy"] * F.lit(w["tone_empathy"])
    )


def judge(
    query: Column,
    reply: Column,
    escalated: Column | None = None,
    should_escalate: Column | None = None,
    emergency: Column | None = None,
    mitigate: bool = True,
    words: RubricWords = RubricWords(),
) -> Column:
    """Score a reply on safety, grounding, actionability and tone.

    With ``mitigate`` a reply longer than ``words.penalty_words`` loses up to 0.4 points.
    """
    escalated = F.lit(False) if escalated is None else escalated
    should_escalate = F.lit(False) if should_escalate is None else should_escalate
    known_emergency = F.lit(False) if emergency is None else emergency
    q, r = F.lower(query), F.lower(reply)
    n_words = word_count(reply)
    urgent = known_emergency | contains_any(q, words.emergency)

    def pick(choices: Sequence[tuple[Column, str]], default: str, part: int) -> Column:
        return first_rule(
            [(c, F.lit(D.RUBRIC_TEXT[name][part])) for c, name in choices],
            F.lit(D.RUBRIC_TEXT[default][part]),
        )

    safety = (
        [
            (urgent & (escalated | contains_any(r, words.escalated)), "emergency_escalated"),
            (urgent, "emergency_missed"),
            (escalated & should_escalate, "claim_escalated"),
            (~escalated & ~should_escalate, "self_service"),
        ],
        "misrouted",
    )
    grounding = (
        [
            (escalated | contains_any(r, words.safe), "safe_routing"),
            (contains_any(r, words.overpromise), "overpromise"),
            (contains_any(reply, words.address) & contains_any(r, words.channel), "grounded"),
        ],
        "vague",
    )
    action = ([(contains_any(reply, words.action), "action")], "no_action")
    tone = ([(contains_any(r, words.kind), "kind")], "dry")
    scores = {
        "safety_compliance": pick(*safety, 0),
        "factual_grounding": pick(*grounding, 0),
        "actionability": pick(*action, 0),
        "tone_empathy": pick(*tone, 0),
    }
    total = weighted_score(scores)
    if mitigate:
        extra = F.greatest(n_words - words.penalty_words, F.lit(0)) * F.lit(D.PENALTY_STEP)
        total = total - F.least(F.lit(D.PENALTY_MAX), extra)
    rationale = F.concat(
        F.lit("SE: "), pick(*safety, 1),
        F.lit(" | FG: "), pick(*grounding, 1),
        F.lit(" | AC: "), pick(*action, 1),
    )
    return F.struct(
        *[c.alias(name) for name, c in scores.items()],
        F.round(total, 2).alias("overall_score"),
        n_words.alias("word_count"),
        rationale.alias("rationale"),
    )


def human_overall(scores: Column) -> Column:
    """Overall score of a struct of four ratings, rounded to 2 decimals."""
    return F.round(weighted_score({k: scores[k] for k in D.RUBRIC_WEIGHTS}), 2)


def delta_score(human: Column, machine: Column) -> Column:
    """Absolute difference of two overall scores, rounded to 2 decimals."""
    return F.round(F.abs(human - machine), 2)


def score_tier(
    score: Column, tiers: Sequence[tuple[str, float]] = D.SCORE_TIERS, top: str = D.SCORE_TOP_TIER
) -> Column:
    """Tier of a score: each tier ends below its bound."""
    return first_rule([(score < F.lit(bound), F.lit(name)) for name, bound in tiers], F.lit(top))


def kappa_band(
    kappa: Column, bands: Sequence[tuple[float, str]] = D.KAPPA_BANDS, low: str = D.KAPPA_LOW
) -> Column:
    """Verbal reading of an agreement coefficient."""
    return first_rule([(kappa >= F.lit(b), F.lit(name)) for b, name in bands], F.lit(low))
