"""Metrics, curves, agreement and gold-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from replyloom import defaults as D
from replyloom import fixtures as X
from replyloom.functions import judge as J
from replyloom.operators import curves as C
from replyloom.operators import gold as G
from replyloom.operators import metrics as M
from replyloom.operators.threads import substantive
from replyloom.plans import escalation as E
from replyloom.plans import systems as Y
from replyloom.registry.common import GUARD, sql_words
from replyloom.registry.text import (
    GOLD_RULES, ROUTER, ROUTER_DEFAULT, RUBRIC, SQL_SCRUB, SQL_SPOKEN, _gold_sql,
    _judge_sql, _sql_contains, conversation_threads, reply_pairs,
)

SQL_HEX = "(strpos('0123456789abcdef', substr(h, {0}, 1)) - 1)"
SQL_GOLD = f"""hashed AS (SELECT l.*, d.text, d.lang, d.source, md5(l.doc_id::varchar) AS h
  FROM labels l JOIN documents d USING (doc_id)),
numbered AS (SELECT *, ({SQL_HEX.format(1)} * 4096 + {SQL_HEX.format(2)} * 256
  + {SQL_HEX.format(3)} * 16 + {SQL_HEX.format(4)}) % 1000 AS r FROM hashed),
gold AS (SELECT doc_id, text, lang, source, toxic AS y, 1 - quality AS y2,
  round(r / 1000.0::double * 0.6::double + toxic * 0.3::double, 3) AS p FROM numbered)"""
SQL_COUNTS = """count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y <> 1 AND pred = 1) AS fp,
  count(*) FILTER (y <> 1 AND pred <> 1) AS tn, count(*) FILTER (y = 1 AND pred <> 1) AS fn"""
SQL_METRICS = """tp / greatest(1.0::double, tp + fp) AS precision,
  tp / greatest(1.0::double, tp + fn) AS recall, fn * 15.0::double + fp * 1.0::double AS cost"""
SQL_CURVE = f"""taus AS (SELECT i::int AS i, round(0.05::double + i * 0.01::double, 2) AS threshold
  FROM range(0, 91) t(i)),
counted AS (SELECT i, threshold, {SQL_COUNTS.replace("pred = 1", "p >= threshold").replace(
    "pred <> 1", "p < threshold")} FROM taus, gold GROUP BY i, threshold),
rated AS (SELECT *, {SQL_METRICS} FROM counted),
curve AS (SELECT *, 2 * precision * recall / greatest(1e-8::double, precision + recall) AS f1
  FROM rated)"""
SQL_SCORES = """points AS (SELECT p AS score, count(*) FILTER (y = 1) AS pos,
  count(*) FILTER (y <> 1) AS neg FROM gold GROUP BY p),
summed AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg FROM points)"""
METRIC = ("precision", "recall", "f1")


def _six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _predicted(s, d):
    return X.gold(s, d).withColumn("pred", (F.col("p") >= 0.45).cast("int"))


def _curve(s, d):
    return C.cost_curve(X.gold(s, d))


def kappa_sql(table: str, a: str, b: str) -> str:
    return f"""(SELECT (po - pe) / (1 - pe) FROM (SELECT avg(({a} = {b})::int) AS po FROM {table}),
  (SELECT sum(n1 * n2) AS pe FROM (SELECT {a} AS c, count(*) / (SELECT count(*) FROM {table}) AS n1
    FROM {table} GROUP BY 1) JOIN (SELECT {b} AS c, count(*) / (SELECT count(*) FROM {table}) AS n2
    FROM {table} GROUP BY 1) USING (c)))"""


def _ratings(s, d):
    """Reply pairs scored by the rubric and by a second rater made from the pair's length."""
    rows = reply_pairs(s, d).withColumn("j", J.judge(F.col("query"), F.col("reply"), words=RUBRIC))
    human = 1 + F.length("query") % 5
    return rows.select(
        "conv_id", "turn",
        human.cast("double").alias("human_overall_score"),
        F.col("j.overall_score").alias("machine_overall_score"),
        J.delta_score(human.cast("double"), F.col("j.overall_score")).alias("delta_score"),
    )


def _plain_judge_sql() -> str:
    sql = _judge_sql().replace("u.conv_id % 3 = 0 AS esc", "false AS esc").replace(
        "u.conv_id % 2 = 0 AS should", "false AS should, 1 + length(u.text) % 5 AS human"
    )
    return sql.replace("SELECT conv_id, turn,\n", "SELECT conv_id, turn, human,\n", 1)


SQL_RATINGS = f"""ratings AS (SELECT conv_id, turn, human::double AS human, overall,
  round(abs(human - overall)::varchar::decimal(20, 16), 2)::double AS delta,
  CASE WHEN human < 3 THEN 'POOR' WHEN human < 4.3 THEN 'SATISFACTORY' ELSE 'EXCELLENT' END AS ht,
  CASE WHEN overall < 3 THEN 'POOR' WHEN overall < 4.3 THEN 'SATISFACTORY' ELSE 'EXCELLENT' END AS mt
  FROM ({_plain_judge_sql()}))"""


def _relabels(s, d):
    return X.gold(s, d).select(
        F.col("doc_id").alias("id"),
        F.col("y").alias("original_escalate"),
        F.col("y2").alias("blind_relabel_escalate"),
        F.when(F.col("lang") != "es", F.col("y") == F.col("y2")).alias("is_consistent"),
    )


def _trials(s, d):
    """Pairwise judgements of the embeddings' neighbours: both orders of each label pair."""
    e = X.table(s, d, "embeddings").select(
        F.col("vec_id").alias("item"),
        (F.col("embedding")[0] > F.col("embedding")[1]).cast("int").alias("w1"),
        (F.col("embedding")[2] > F.col("embedding")[3]).cast("int").alias("w2"),
    )
    forward = e.select(
        "item", F.lit("a").alias("first"), F.lit("b").alias("second"), F.col("w1").alias("win")
    )
    back = e.select(
        "item", F.lit("b").alias("first"), F.lit("a").alias("second"), F.col("w2").alias("win")
    )
    return forward.unionByName(back)


def _gaps(s, d):
    pairs = reply_pairs(s, d).select(
        "conv_id", "turn", "query", F.col("reply").alias("left_reply"),
        F.concat_ws(" ", "reply", "query").alias("right_reply"),
    )
    return M.judge_gap(pairs, words=RUBRIC).select(
        "conv_id", "turn", "unmitigated_gap", "mitigated_gap"
    )


def _gap_sql() -> str:
    def scores(reply: str, penalty: bool) -> str:
        sql = _plain_judge_sql().replace("a.text AS reply", f"{reply} AS reply")
        return sql if penalty else sql.replace("* 0.01::double", "* 0.0::double")

    left, right = "a.text", "a.text || ' ' || u.text"
    return f"""SELECT conv_id, turn,
  round((d.overall - c.overall)::varchar::decimal(20, 16), 2)::double AS unmitigated_gap,
  round((b.overall - a.overall)::varchar::decimal(20, 16), 2)::double AS mitigated_gap
FROM ({scores(left, True)}) a JOIN ({scores(right, True)}) b USING (conv_id, turn)
JOIN ({scores(left, False)}) c USING (conv_id, turn) JOIN ({scores(right, False)}) d USING (conv_id, turn)"""


def _corrections(s, d):
    gold = X.gold(s, d).select(
        F.col("doc_id").alias("id"), F.col("y").alias("ground_truth_escalate"),
        F.col("source").alias("ground_truth_intent"), F.col("lang").alias("human_rationale"),
    )
    notes = F.element_at(
        F.array(*[F.lit(x) for x in ("", "-", "4.5", "checked again")]),
        (F.col("id") % 4 + 1).cast("int"),
    )
    corrections = gold.where("human_rationale <> 'en'").select(
        "id", (1 - F.col("ground_truth_escalate")).alias("ground_truth_escalate"),
        F.when(F.col("human_rationale") == "fr", F.lit("NEW")).otherwise(F.lit(" ")).alias(
            "ground_truth_intent"
        ),
        notes.alias("human_rationale"),
    )
    return G.apply_corrections(gold, corrections, F.lit("now"))


def _existing(s, d):
    return X.gold(s, d).where("lang = 'de'").select(
        F.col("doc_id").alias("thread_id"), F.col("y").alias("ground_truth_escalate")
    )


def _candidates(s, d):
    return X.gold(s, d).select(
        F.col("doc_id").alias("thread_id"), F.col("y").alias("ground_truth_escalate"), "source"
    )


SQL_ORDER = "md5(concat_ws(':', {0}::varchar, '{1}')), {0}"


def _balanced(s, d):
    threads = conversation_threads(s, d)
    existing = threads.where("num_turns = 2").select(
        F.concat(F.lit("OLD_"), F.lpad(F.col("root_tweet_id").cast("string"), 9, "0")).alias("id"),
        "thread_id", F.col("customer_inquiry_text").alias("text"),
        F.col("initial_brand_reply").alias("actual_historical_reply"),
        F.lit(1).alias("ground_truth_escalate"), F.lit("OLD").alias("ground_truth_intent"),
        F.lit("kept").alias("human_rationale"), F.lit("then").alias("labeled_at"),
    )
    out = G.balance_gold(
        threads, existing, 60, labelled_at=F.lit("now"), rules=GOLD_RULES, question_mark="."
    )
    return out.select(
        "id", "thread_id", "ground_truth_escalate", "ground_truth_intent", "labeled_at"
    )


def _balanced_sql() -> str:
    verdict = _gold_sql().replace("FROM documents", "FROM fresh").replace(
        "SELECT doc_id", "SELECT thread_id"
    )
    return f"""WITH {SQL_SPOKEN}, threads AS (
  SELECT 'delta_thread_' || (conv_id * 100 + root) AS thread_id, conv_id * 100 + root AS root_id, num_turns,
    {SQL_SCRUB.format('inquiry')} AS text, {SQL_SCRUB.format('reply')} AS reply
  FROM judged WHERE num_turns >= 2 AND fb IS NOT NULL),
old AS (SELECT * FROM threads WHERE num_turns = 2),
fresh AS (SELECT * FROM threads WHERE num_turns <> 2 AND {sql_words('text')} >= 6
  AND {sql_words('reply')} >= 6),
verdicts AS ({verdict}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY escalate
  ORDER BY {SQL_ORDER.format('thread_id', 42)}) AS rk FROM verdicts),
taken AS (SELECT * FROM ranked
  WHERE rk <= 30 - CASE WHEN escalate = 1 THEN (SELECT count(*) FROM old) ELSE 0 END),
everything AS (SELECT 0 AS g, 'OLD_' || lpad(root_id::varchar, 9, '0') AS place, thread_id,
    1 AS ground_truth_escalate, 'OLD' AS ground_truth_intent, 'then' AS labeled_at FROM old
  UNION ALL SELECT CASE WHEN escalate = 1 THEN 1 ELSE 2 END, lpad(rk::varchar, 12, '0'), thread_id,
    escalate, intent, 'now' FROM taken)
SELECT 'GOLD_' || lpad((row_number() OVER (ORDER BY g, place, thread_id))::varchar, 3, '0') AS id,
  thread_id, ground_truth_escalate, ground_truth_intent, labeled_at FROM everything"""


def _labelled_candidates(s, d):
    threads = conversation_threads(s, d)
    labels = threads.where("num_turns = 3").select("thread_id")
    return G.label_candidates(threads, labels, 200).select("thread_id", "num_turns")


def _rated(s, d):
    return Y.rating_candidates(conversation_threads(s, d), 30, words=RUBRIC).select(
        "thread_id", F.col("judge_eval.word_count").alias("words"),
        F.col("judge_eval.actionability").alias("actionability"),
    )


def _static_systems(s, d):
    q = X.gold(s, d).withColumnRenamed("doc_id", "query_id")
    answers = [
        Y.system_constant(q), Y.system_keyword(q, ROUTER, ROUTER_DEFAULT),
    ]
    return _six(Y.benchmark(answers), *METRIC, "mean_grounding_fidelity")


def _routed(s, d):
    r = Y.route(X.gold(s, d), 0.45, rules=GUARD, group=2)
    return r.select(
        "doc_id", "escalate_to_human", "confidence", "predicted_intent", "escalation_reason"
    )


def _guard_case(value, default: str) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches(text, '{p}') THEN {value(n, p)}" for n, p in GUARD
    ) + f" ELSE {default} END"


GUARD_NAME = _guard_case(lambda n, p: f"'{n}'", "NULL")
GUARD_PHRASE = _guard_case(lambda n, p: f"regexp_extract(text, '{p}', 2)", "NULL")
SQL_HIT = f"hit AS (SELECT *, {GUARD_NAME} AS category, {GUARD_PHRASE} AS phrase FROM gold)"


def _protected(s, d):
    return E.protection_check(
        X.gold(s, d).select("doc_id", F.col("text").alias("query"), F.col("p").alias("confidence")),
        rules=GUARD, group=2,
    ).drop("query")


def _calibrated(s, d):
    scored = E.hybrid_probability(X.gold(s, d), rules=GUARD[:2], group=2)
    return _six(E.calibrate_scores(scored), *METRIC, "pr_auc", "roc_auc")


AREA = """round(sum((fp - (fp - neg)) * (tp + tp - pos) / 2.0 / all_neg / all_pos), 6) AS roc_auc"""
PR_AREA = """round(sum(pos / all_pos * (tp / (tp + fp) + CASE WHEN tp - pos + fp - neg > 0
  THEN (tp - pos) / (tp - pos + fp - neg) ELSE 1 END) / 2.0), 6) AS pr_auc"""

ENTRIES = {
    "class_balance": (
        lambda s, d: _six(M.class_balance(X.gold(s, d), "y"), "share"),
        f"WITH {SQL_GOLD} SELECT y, count(*) AS rows, round(count(*) / (SELECT count(*) FROM gold), 6) "
        "AS share FROM gold GROUP BY y",
    ),
    "distinct_classes": (
        lambda s, d: M.distinct_classes(X.table(s, d, "documents"), "source"),
        "SELECT DISTINCT source FROM documents",
    ),
    "confusion": (
        lambda s, d: M.confusion(_predicted(s, d), ["lang"]),
        f"WITH {SQL_GOLD}, said AS (SELECT *, (p >= 0.45)::int AS pred FROM gold) "
        f"SELECT lang, {SQL_COUNTS} FROM said GROUP BY lang",
    ),
    "binary_metrics": (
        lambda s, d: _six(M.binary_metrics(_predicted(s, d), ["source"]), *METRIC),
        f"""WITH {SQL_GOLD}, said AS (SELECT *, (p >= 0.45)::int AS pred FROM gold),
c AS (SELECT source, {SQL_COUNTS} FROM said GROUP BY source), r AS (SELECT *, {SQL_METRICS} FROM c)
SELECT * REPLACE (round(precision, 6) AS precision, round(recall, 6) AS recall),
  round(2 * precision * recall / greatest(1e-8::double, precision + recall), 6) AS f1 FROM r""",
    ),
    "cost_curve": (
        lambda s, d: _six(_curve(s, d), *METRIC),
        f"WITH {SQL_GOLD}, {SQL_CURVE} SELECT * REPLACE (round(precision, 6) AS precision, "
        "round(recall, 6) AS recall, round(f1, 6) AS f1) FROM curve",
    ),
    "best_threshold": (
        lambda s, d: _six(C.best_threshold(_curve(s, d)), *METRIC),
        f"WITH {SQL_GOLD}, {SQL_CURVE} SELECT * REPLACE (round(precision, 6) AS precision, "
        "round(recall, 6) AS recall, round(f1, 6) AS f1) FROM curve ORDER BY cost, threshold LIMIT 1",
    ),
    "sample_curve": (
        lambda s, d: C.sample_curve(_curve(s, d)).select("i", "threshold", "cost"),
        f"WITH {SQL_GOLD}, {SQL_CURVE} SELECT i, threshold, cost FROM curve WHERE i % 10 = 0",
    ),
    "pr_curve": (
        lambda s, d: _six(C.pr_curve(X.gold(s, d)), "precision", "recall"),
        f"WITH {SQL_GOLD}, {SQL_SCORES} SELECT score, round(tp / (tp + fp), 6) AS precision, "
        "round(tp / all_pos, 6) AS recall FROM summed UNION ALL SELECT NULL, 1.0, 0.0",
    ),
    "roc_curve": (
        lambda s, d: _six(C.roc_curve(X.gold(s, d)), "fpr", "tpr"),
        f"WITH {SQL_GOLD}, {SQL_SCORES} SELECT score, round(fp / all_neg, 6) AS fpr, "
        "round(tp / all_pos, 6) AS tpr FROM summed UNION ALL SELECT NULL, 0.0, 0.0",
    ),
    "pr_auc": (
        lambda s, d: _six(C.pr_auc(X.gold(s, d)), "pr_auc"),
        f"WITH {SQL_GOLD}, {SQL_SCORES} SELECT {PR_AREA} FROM summed",
    ),
    "roc_auc": (
        lambda s, d: _six(C.roc_auc(X.gold(s, d)), "roc_auc"),
        f"WITH {SQL_GOLD}, {SQL_SCORES} SELECT {AREA} FROM summed",
    ),
    "kappa": (
        lambda s, d: _six(M.cohen_kappa(X.gold(s, d), "y", "y2"), "agreement", "kappa"),
        f"WITH {SQL_GOLD} SELECT count(*) AS n, round(avg((y = y2)::int), 6) AS agreement, "
        f"round({kappa_sql('gold', 'y', 'y2')}, 6) AS kappa FROM gold",
    ),
    "agreement": (
        lambda s, d: _six(
            M.agreement(X.gold(s, d), "y", "y2", ["source"]), "agreement", "drift_share"
        ),
        f"WITH {SQL_GOLD} SELECT source, count(*) AS n, round(avg((y = y2)::int), 6) AS agreement, "
        "count(*) FILTER (y <> y2) AS drift_count, round(avg((y <> y2)::int), 6) AS drift_share "
        "FROM gold GROUP BY source",
    ),
    "drift_cases": (
        lambda s, d: M.drift_cases(_relabels(s, d)).select("id", "original_escalate"),
        f"WITH {SQL_GOLD} SELECT doc_id AS id, y AS original_escalate FROM gold "
        "WHERE lang <> 'es' AND y <> y2",
    ),
    "disagreements": (
        lambda s, d: M.disagreements(_ratings(s, d)),
        f"WITH {SQL_RATINGS} SELECT conv_id, turn, human AS human_overall_score, "
        "overall AS machine_overall_score, delta AS delta_score FROM ratings WHERE delta >= 1.5",
    ),
    "agreement_study": (
        lambda s, d: _six(M.agreement_study(_ratings(s, d)), "cohens_kappa"),
        f"""WITH {SQL_RATINGS}, k AS (SELECT {kappa_sql('ratings', 'ht', 'mt')} AS kappa)
SELECT (SELECT count(*) FROM ratings) AS total_cases, round(kappa, 6) AS cohens_kappa,
  CASE WHEN kappa >= 0.8 THEN 'Near-Perfect Agreement' WHEN kappa >= 0.6 THEN 'Substantial Agreement'
    WHEN kappa >= 0.4 THEN 'Moderate Agreement' ELSE 'Fair / Weak Agreement' END AS interpretation,
  (SELECT count(*) FROM ratings WHERE delta >= 1.5) AS large_disagreements FROM k""",
    ),
    "relabel_audit": (
        lambda s, d: _six(
            M.relabel_audit(X.table(s, d, "documents"), _relabels(s, d)), "agreement", "kappa"
        ),
        f"""WITH {SQL_GOLD}, drift AS (SELECT doc_id FROM gold WHERE lang <> 'es' AND y <> y2)
SELECT (SELECT count(*) FROM documents) AS total_gold, count(*) AS audit_size,
  round(avg((y = y2)::int), 6) AS agreement, round({kappa_sql('gold', 'y', 'y2')}, 6) AS kappa,
  (SELECT count(*) FROM drift) AS drift_cases,
  (SELECT string_agg(doc_id::varchar, ',' ORDER BY doc_id)
   FROM (SELECT doc_id FROM drift ORDER BY doc_id LIMIT 3)) AS drift_examples FROM gold""",
    ),
    "position_inconsistency": (
        lambda s, d: _six(
            M.position_inconsistency(
                X.table(s, d, "embeddings").select(
                    "label",
                    (F.col("embedding")[0] > F.col("embedding")[1]).cast("int").alias("a_first_win"),
                    (F.col("embedding")[2] > F.col("embedding")[3]).cast("int").alias("b_first_win"),
                ),
                ["label"],
            ),
            "inconsistency",
        ),
        "SELECT label, count(*) AS trials, round(abs(count(*) FILTER (embedding[1] > embedding[2]) "
        "- (count(*) - count(*) FILTER (embedding[3] > embedding[4]))) / count(*), 6) AS inconsistency "
        "FROM embeddings GROUP BY label",
    ),
    "pairwise_score": (
        lambda s, d: M.pairwise_score(_trials(s, d)),
        """WITH w AS (SELECT vec_id AS item, (embedding[1] > embedding[2])::int AS a,
  (embedding[3] > embedding[4])::int AS b FROM embeddings)
SELECT item, 'a' AS first, 'b' AS second, 0.5::double * (a + 1 - b) AS score FROM w
UNION ALL SELECT item, 'b', 'a', 0.5::double * (b + 1 - a) FROM w""",
    ),
    "judge_gap": (_gaps, _gap_sql()),
    "human_overall": (
        lambda s, d: X.table(s, d, "part").select(
            "p_partkey",
            J.human_overall(
                F.struct(
                    (F.col("p_size") % 5 + 1).cast("double").alias("safety_compliance"),
                    (F.col("p_size") % 4 + 1).cast("double").alias("factual_grounding"),
                    (F.col("p_size") % 3 + 1).cast("double").alias("actionability"),
                    (F.col("p_size") % 2 + 1).cast("double").alias("tone_empathy"),
                )
            ).alias("overall"),
        ),
        "SELECT p_partkey, round(((p_size % 5 + 1) * 0.35::double + (p_size % 4 + 1) * 0.30::double "
        "+ (p_size % 3 + 1) * 0.20::double + (p_size % 2 + 1) * 0.15::double)::varchar::decimal(20, 16), 2)"
        "::double AS overall FROM part",
    ),
    "validate_labels": (
        lambda s, d: G.validate_labels(
            X.table(s, d, "part").select(
                "p_partkey",
                F.when(F.col("p_size") % 7 == 0, F.col("p_size").cast("string"))
                .otherwise(F.col("p_name")).alias("human_rationale"),
                (F.col("p_size") / 9.0).cast("double").alias("tone"),
            ),
            ratings=["tone"],
        ).select("p_partkey", "valid", "problem"),
        """SELECT p_partkey, problem IS NULL AS valid, problem FROM (SELECT p_partkey,
  CASE WHEN p_size % 7 = 0 THEN 'human_rationale looks like a number'
    WHEN p_size / 9.0 < 1 OR p_size / 9.0 > 5 THEN 'tone out of range' END AS problem FROM part)""",
    ),
    "unlabelled": (
        lambda s, d: G.unlabelled(
            X.table(s, d, "documents").select("doc_id", "source"), X.table(s, d, "labels"), "doc_id"
        ),
        "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "pair_relabels": (
        lambda s, d: G.pair_relabels(
            X.gold(s, d).select(
                F.col("doc_id").alias("id"), F.col("lang").alias("text"),
                F.col("y").alias("ground_truth_escalate"),
            ),
            X.table(s, d, "labels").select(
                F.col("doc_id").alias("id"), (1 - F.col("quality")).alias("blind_relabel_escalate")
            ),
        ),
        f"WITH {SQL_GOLD} SELECT doc_id AS id, lang AS text, y AS original_escalate, "
        "y2 AS blind_relabel_escalate, y = y2 AS is_consistent FROM gold",
    ),
    "apply_corrections": (
        _corrections,
        f"""WITH {SQL_GOLD}, c AS (SELECT *, lang <> 'en' AS hit FROM gold)
SELECT doc_id AS id, CASE WHEN hit THEN 1 - y ELSE y END AS ground_truth_escalate,
  CASE WHEN lang = 'fr' THEN 'NEW' ELSE source END AS ground_truth_intent,
  CASE WHEN NOT hit THEN lang WHEN doc_id % 4 = 1 THEN '' WHEN doc_id % 4 = 3 THEN 'checked again'
    ELSE lang END AS human_rationale,
  CASE WHEN hit THEN 'now' END AS corrected_at FROM c""",
    ),
    "hash_sample": (
        lambda s, d: G.hash_sample(
            X.table(s, d, "documents").select("doc_id", "lang"), "doc_id", 42, 120
        ),
        f"SELECT doc_id, lang FROM documents ORDER BY {SQL_ORDER.format('doc_id', 42)} LIMIT 120",
    ),
    "audit_slice": (
        lambda s, d: G.audit_slice(X.gold(s, d).select("doc_id", "y"), "doc_id"),
        f"WITH {SQL_GOLD} SELECT doc_id, y FROM gold ORDER BY {SQL_ORDER.format('doc_id', 99)} "
        "LIMIT (SELECT greatest(3, least(count(*), ceil(count(*) * 0.2)))::bigint FROM labels)",
    ),
    "first_n_per": (
        lambda s, d: G.first_n_per(
            X.table(s, d, "documents").select("source", "doc_id", "n_chars"), ["source"],
            ["doc_id"], 3,
        ),
        "SELECT * FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source "
        "ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 3",
    ),
    "quota_sample": (
        lambda s, d: G.quota_sample(_candidates(s, d), _existing(s, d), 400).drop("source"),
        f"""WITH {SQL_GOLD}, have AS (SELECT y, count(*) AS n FROM gold WHERE lang = 'de' GROUP BY y),
r AS (SELECT doc_id AS thread_id, y AS ground_truth_escalate, row_number() OVER (PARTITION BY y
  ORDER BY {SQL_ORDER.format('doc_id', 42)}) AS rank FROM gold)
SELECT r.* FROM r LEFT JOIN have ON have.y = ground_truth_escalate
WHERE rank <= 200 - coalesce(n, 0)""",
    ),
    "renumber": (
        lambda s, d: G.renumber(
            X.table(s, d, "documents").select("doc_id", "source"), ["source", "doc_id"]
        ),
        "SELECT doc_id, source, 'GOLD_' || CASE WHEN n < 1000 THEN lpad(n::varchar, 3, '0') "
        "ELSE n::varchar END AS id FROM (SELECT doc_id, source, row_number() OVER (ORDER BY source, "
        "doc_id) AS n FROM documents)",
    ),
    "append_gold": (
        lambda s, d: G.append_gold(
            _existing(s, d),
            G.unlabelled(_candidates(s, d), _existing(s, d)).drop("source"),
        ),
        f"WITH {SQL_GOLD} SELECT doc_id AS thread_id, y AS ground_truth_escalate FROM gold",
    ),
    "substantive": (
        lambda s, d: substantive(reply_pairs(s, d), "query", "reply", 40, 100).select(
            "conv_id", "turn"
        ),
        f"""SELECT u.conv_id, u.turn FROM conversations u JOIN conversations a
ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'
AND {sql_words('u.text')} >= 40 AND {sql_words('a.text')} >= 100""",
    ),
    "label_candidates": (
        _labelled_candidates,
        f"""WITH {SQL_SPOKEN}, threads AS (SELECT 'delta_thread_' || (conv_id * 100 + root) AS thread_id,
  conv_id * 100 + root AS root_id, num_turns FROM judged WHERE num_turns >= 2 AND fb IS NOT NULL
  AND {sql_words('inquiry')} >= 6 AND {sql_words('reply')} >= 6),
sampled AS (SELECT * FROM threads WHERE num_turns <> 3 ORDER BY {SQL_ORDER.format('thread_id', 42)} LIMIT 200)
SELECT thread_id, num_turns FROM sampled""",
    ),
    "rating_candidates": (
        _rated,
        f"""WITH {SQL_SPOKEN}, threads AS (SELECT 'delta_thread_' || (conv_id * 100 + root) AS thread_id,
  conv_id * 100 + leaf AS leaf_id, {SQL_SCRUB.format('reply')} AS reply FROM judged
  WHERE num_turns >= 2 AND fb IS NOT NULL AND {sql_words('inquiry')} >= 6
  AND {sql_words('reply')} >= 6 ORDER BY {SQL_ORDER.format('(conv_id * 100 + leaf)', 123)} LIMIT 30)
SELECT thread_id, {sql_words('reply')} AS words, CASE WHEN {_sql_contains(RUBRIC.action, 'reply')}
  THEN 4.8::double ELSE 2.0::double END AS actionability FROM threads""",
    ),
    "balance_gold": (_balanced, _balanced_sql()),
    "route_scores": (
        _routed,
        f"""WITH {SQL_GOLD}, {SQL_HIT} SELECT doc_id, category IS NOT NULL OR p >= 0.45
  AS escalate_to_human, CASE WHEN category IS NOT NULL THEN 1.0 WHEN p >= 0.45 THEN p
    ELSE round(1 - p, 4) END AS confidence,
  coalesce('TIER_0_' || category, 'TIER_1_OPERATIONAL_INQUIRY') AS predicted_intent,
  CASE WHEN category IS NOT NULL THEN 'Tier-0 Preemptive Override: [' || category
      || '] (Trigger token: ''' || phrase || ''')'
    WHEN p >= 0.45 THEN 'Calibrated probability (' || printf('%.2f', round(p::varchar::decimal(20, 16), 2))
      || ' >= 0.45)'
    ELSE 'None' END AS escalation_reason FROM hit""",
    ),
    "protection_check": (
        _protected,
        f"""WITH {SQL_GOLD}, {SQL_HIT} SELECT doc_id, p AS confidence,
  category IS NOT NULL AS guardrail_triggered, category AS guardrail_category,
  phrase AS matched_token,
  CASE WHEN category IS NOT NULL OR p < 0.4 THEN 'ESCALATED' ELSE 'NOT_ESCALATED' END
    AS final_decision,
  CASE WHEN category IS NOT NULL THEN 'PROTECTED' ELSE 'VULNERABLE' END AS proof_status FROM hit""",
    ),
    "calibrate_scores": (
        _calibrated,
        f"""WITH {SQL_GOLD.replace("gold AS (", "plain AS (")},
gold AS (SELECT * REPLACE (CASE WHEN regexp_matches(text, '{GUARD[0][1]}')
  OR regexp_matches(text, '{GUARD[1][1]}') THEN 1.0 ELSE p END AS p) FROM plain),
{SQL_CURVE}, {SQL_SCORES}
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  fn, fp, tp, tn, cost, (SELECT {PR_AREA} FROM summed) AS pr_auc,
  (SELECT {AREA} FROM summed) AS roc_auc,
  (SELECT count(*) FROM plain WHERE regexp_matches(text, '{GUARD[0][1]}')
    OR regexp_matches(text, '{GUARD[1][1]}')) AS guardrail_hits
FROM curve ORDER BY cost, threshold LIMIT 1""",
    ),
    "system_benchmark": (
        _static_systems,
        f"""WITH {SQL_GOLD}, answers AS (
  SELECT '{D.CONSTANT_SYSTEM}' AS system, y, 0 AS pred FROM gold
  UNION ALL SELECT '{D.KEYWORD_SYSTEM}', y, (NOT {_sql_contains(ROUTER[0][0])}
    AND {_sql_contains(ROUTER[1][0])})::int FROM gold),
c AS (SELECT system, {SQL_COUNTS}, round(avg(CASE WHEN pred = 1 AND y = 1 THEN 1.0
    WHEN system LIKE '%Canned%' THEN 0.2 ELSE 0.5 END), 6) AS mean_grounding_fidelity
  FROM answers GROUP BY system), r AS (SELECT *, {SQL_METRICS} FROM c)
SELECT * REPLACE (round(precision, 6) AS precision, round(recall, 6) AS recall),
  round(2 * precision * recall / greatest(1e-8::double, precision + recall), 6) AS f1 FROM r""",
    ),
}
