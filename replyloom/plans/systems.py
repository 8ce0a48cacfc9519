"""The compared reply systems and their benchmark."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom import defaults as D
from replyloom.functions.judge import judge
from replyloom.functions.rules import (
    guardrail, keyword_router, severity_tier, template_reply,
)
from replyloom.operators.gold import hash_sample
from replyloom.operators.metrics import add_binary_metrics, grounding
from replyloom.operators.retrieval import retrieve
from replyloom.operators.threads import substantive
from replyloom.operators.tfidf import TfidfModel
from replyloom.plans.escalation import Rules, TextClassifier
from replyloom.runtime import materialize, salted_join

#: columns every system returns, next to those of its input
ANSWER = (
    "system", "predicted_intent", "confidence", "escalate_to_human", "escalation_reason",
    "generated_reply", "retrieved_examples_count", "top_resolution",
)


def _answer(df: DataFrame, **values: Column) -> DataFrame:
    values.setdefault("retrieved_examples_count", F.lit(0))
    values.setdefault("top_resolution", F.lit(None).cast("double"))
    return df.withColumns({name: values[name] for name in ANSWER})


def system_constant(queries: DataFrame) -> DataFrame:
    """Always the same canned reply, never escalates."""
    return _answer(
        queries,
        system=F.lit(D.CONSTANT_SYSTEM),
        predicted_intent=F.lit(D.CONSTANT_INTENT),
        confidence=F.lit(D.CONSTANT_CONFIDENCE),
        escalate_to_human=F.lit(False),
        escalation_reason=F.lit("None"),
        generated_reply=F.lit(D.CONSTANT_REPLY),
    )


def system_keyword(
    queries: DataFrame, rules=D.ROUTER_RULES, default=D.ROUTER_DEFAULT, text: str = "text"
) -> DataFrame:
    """Ordered keyword groups with a drafted reply each."""
    routed = queries.withColumn("_r", keyword_router(F.col(text), rules, default))
    return _answer(
        routed,
        system=F.lit(D.KEYWORD_SYSTEM),
        predicted_intent=F.col("_r.intent"),
        confidence=F.lit(D.ROUTER_CONFIDENCE),
        escalate_to_human=F.col("_r.escalate"),
        escalation_reason=F.when(F.col("_r.escalate"), D.ROUTER_REASON).otherwise("None"),
        generated_reply=F.col("_r.reply"),
    ).drop("_r")


def template_answers(
    scored: DataFrame, cutoff: float = D.TEMPLATE_CUTOFF, templates=D.TEMPLATES
) -> DataFrame:
    """Static reply of the most likely intent; escalates below the confidence cutoff.

    ``scored`` has the columns intent and top_p.
    """
    unsure = F.col("top_p") < F.lit(cutoff)
    return _answer(
        scored,
        system=F.lit(D.TEMPLATE_SYSTEM),
        predicted_intent=F.col("intent"),
        confidence=F.round("top_p", 4),
        escalate_to_human=unsure,
        escalation_reason=F.when(unsure, D.TEMPLATE_REASON).otherwise("None"),
        generated_reply=template_reply(F.col("intent"), templates),
    ).drop("intent", "top_p")


def system_tfidf(queries: DataFrame, classifier: TextClassifier, text: str = "text") -> DataFrame:
    """Intent classifier with static reply templates."""
    names = F.array(*[F.lit(c) for c in classifier.classes])
    scored = classifier.probabilities(queries, text).withColumn(
        "top_p", F.array_max("_probabilities")
    )
    best = F.array_position("_probabilities", F.col("top_p")).cast("int")
    return template_answers(
        scored.withColumn("intent", F.element_at(names, best)).drop("_probabilities")
    )


def decision_reason(hit: Column, escalate: Column, p: Column, tau: float) -> Column:
    """Why a query was escalated: the trigger word, the probability, or nothing."""
    return (
        F.when(
            hit.isNotNull(),
            F.format_string(
                "Tier-0 Preemptive Override: [%s] (Trigger token: '%s')",
                hit["category"], hit["phrase"],
            ),
        )
        .when(
            escalate,
            F.concat(
                F.lit("Calibrated probability ("),
                F.format_string("%.2f", p),
                F.lit(f" >= {tau})"),
            ),
        )
        .otherwise(F.lit("None"))
    )


def route(
    scored: DataFrame, tau: float, text: str = "text", p: str = "p", rules: Rules = D.GUARDRAIL,
    group: int = 0,
) -> DataFrame:
    """Guardrail first, then the calibrated probability. Map-only, so it also runs on streams."""
    hit = F.col("hit")
    by_model = F.col(p) >= F.lit(tau)
    escalate = hit.isNotNull() | by_model
    confidence = (
        F.when(hit.isNotNull(), F.lit(1.0))
        .when(by_model, F.round(p, 4))
        .otherwise(F.round(F.lit(1.0) - F.col(p), 4))
    )
    intent = F.when(
        hit.isNotNull(), F.concat(F.lit(D.ROUTED_TIER0_PREFIX), hit["category"])
    ).otherwise(F.lit(D.ROUTED_TIER1_INTENT))
    return scored.withColumn("hit", guardrail(F.col(text), rules, group)).withColumns(
        {
            "escalate_to_human": escalate,
            "confidence": confidence,
            "predicted_intent": intent,
            "escalation_reason": decision_reason(hit, by_model, F.col(p), tau),
        }
    ).drop("hit")


def choose_reply(
    escalated: Column, resolution: Column, reply: Column,
    dispatch: str = D.DISPATCH_REPLY, fallback: str = D.FALLBACK_REPLY,
) -> Column:
    """Dispatch text, the best hit's trusted answer, or the fallback text."""
    trusted = F.coalesce(resolution >= F.lit(D.TRUSTED_RESOLUTION), F.lit(False))
    return F.when(escalated, F.lit(dispatch)).when(trusted, reply).otherwise(F.lit(fallback))


def full_answers(routed: DataFrame, hits: DataFrame, kb: DataFrame) -> DataFrame:
    """Replies for routed queries from their retrieval hits."""
    hits = materialize(hits, "hits")
    best = hits.where(F.col("rank") == 1).select(
        "query_id", "kb_id", F.col("resolution_score").alias("_resolution")
    )
    # one row per query, but one knowledge row may be the best hit of very many queries
    answers = kb.select("kb_id", F.col("brand_reply").alias("_reply"))
    best = salted_join(best, answers, ["kb_id"], spread=["query_id"])
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("_hits"))
    joined = routed.join(best.drop("kb_id"), "query_id", "left").join(found, "query_id", "left")
    return _answer(
        joined,
        system=F.lit(D.FULL_SYSTEM),
        predicted_intent=F.col("predicted_intent"),
        confidence=F.col("confidence"),
        escalate_to_human=F.col("escalate_to_human"),
        escalation_reason=F.col("escalation_reason"),
        generated_reply=choose_reply(
            F.col("escalate_to_human"), F.col("_resolution"), F.col("_reply")
        ),
        retrieved_examples_count=F.coalesce("_hits", F.lit(0)),
        top_resolution=F.col("_resolution"),
    ).drop("_resolution", "_reply", "_hits")


def system_full(
    queries: DataFrame, kb: DataFrame, retriever: TfidfModel, classifier: TextClassifier,
    tau: float, rules: Rules = D.GUARDRAIL, group: int = 0, k: int = 2,
) -> DataFrame:
    """Guardrail, calibrated escalation and resolution-weighted retrieval.

    ``queries`` has (query_id, text), further columns are kept.
    """
    scored = (
        classifier.probabilities(queries, "text")
        .withColumn("p", F.col("_probabilities")[1])
        .drop("_probabilities")
    )
    return answer_scored(scored, kb, retriever, tau, rules, group, k)


def answer_scored(
    scored: DataFrame, kb: DataFrame, retriever: TfidfModel, tau: float,
    rules: Rules = D.GUARDRAIL, group: int = 0, k: int = 2,
) -> DataFrame:
    """The full system for queries (query_id, text, p) whose probability is known."""
    routed = route(scored, tau, rules=rules, group=group).drop("p")
    hits = retrieve(retriever, scored.select("query_id", "text"), kb, k)
    return full_answers(routed, hits, kb)


def benchmark(
    answers: Mapping[str, DataFrame] | list[DataFrame], y: str = "y",
    c_fn: float = D.COST_MISS, c_fp: float = D.COST_FALSE_ALARM,
) -> DataFrame:
    """One metric row per system over all its answers.

    All counts and the grounding come from one aggregate over the union, combined before the
    shuffle, so the few systems do not concentrate the data.
    """
    tables = list(answers.values()) if isinstance(answers, Mapping) else list(answers)
    columns = ["system", y, "escalate_to_human", "top_resolution"]
    union = tables[0].select(*columns)
    for table in tables[1:]:
        union = union.unionByName(table.select(*columns))
    static = F.col("system").contains("Canned") | F.col("system").contains("Static")
    truth, said = F.col(y) == 1, F.col("escalate_to_human")
    counts = union.groupBy("system").agg(
        F.count_if(truth & said).alias("tp"),
        F.count_if(~truth & said).alias("fp"),
        F.count_if(~truth & ~said).alias("tn"),
        F.count_if(truth & ~said).alias("fn"),
        F.avg(grounding(F.col("top_resolution"), said, F.col(y), static)).alias(
            "mean_grounding_fidelity"
        ),
    )
    return add_binary_metrics(counts, c_fn, c_fp)


def rating_candidates(threads: DataFrame, n: int = 30, seed: int = 123, words=None) -> DataFrame:
    """Substantive question and answer pairs with their rubric score, shuffled."""
    kept = substantive(threads, "customer_inquiry_text", "initial_brand_reply", 6, 6)
    options = {} if words is None else {"words": words}
    # the sample is drawn first: only n rows need a score
    sample = hash_sample(
        kept.select("thread_id", "leaf_tweet_id", "customer_inquiry_text", "initial_brand_reply"),
        "leaf_tweet_id", seed, n,
    )
    return sample.select(
        "thread_id",
        F.col("customer_inquiry_text").alias("query"),
        F.col("initial_brand_reply").alias("system_reply"),
        judge(F.col("customer_inquiry_text"), F.col("initial_brand_reply"), **options).alias(
            "judge_eval"
        ),
    )


def tier_report(cases: DataFrame, severity: str = "severity") -> DataFrame:
    """Edge cases with the tier their severity asks for."""
    return cases.withColumn("primary_tier", severity_tier(F.col(severity)))
