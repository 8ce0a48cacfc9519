"""Masking, rules, rubric and resolution labels over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from replyloom import defaults as D
from replyloom import fixtures as X
from replyloom.functions import judge as J
from replyloom.functions import rules as R
from replyloom.functions.privacy import MaskRules, mask_steps, pii_counts, scrub
from replyloom.functions.text import latin_words, split_signature
from replyloom.operators import resolution as S
from replyloom.operators import threads as T
from replyloom.plans import systems as Y
from replyloom.registry.common import (
    ANGER, CANNED, GUARD, INTENTS, THANKS, linear, sql_words, word,
)

MASK = MaskRules(flags="")
KINDS = ("urls", "emails", "phones", "cards", "pnrs", "tickets", "flights", "handles")


def _mask_sql(select: str) -> str:
    """The masking chain in SQL, one step per common table."""
    steps = [("m0", "text", None)]

    def step(pattern: str, token: str, flags: str = "g") -> None:
        last = steps[-1][0]
        steps.append((f"m{len(steps)}", last, f"regexp_replace(x, '{pattern}', {token}, '{flags}')"))

    marked = "\\x01[^\\x02]*\\x02"
    inside = "\\x01[^\\x02]*{}[^\\x02]*\\x02"
    step(D.URL, "chr(1) || '\\0' || chr(2)")
    step(inside.format("delta\\.com"), f"'{D.TOKEN_BRAND_URL}'", "gi")
    step(inside.format("(?:bit\\.ly|t\\.co)"), f"'{D.TOKEN_SHORT_URL}'", "gi")
    step(marked, f"'{D.TOKEN_OTHER_URL}'")
    step(D.EMAIL, f"'{D.TOKEN_EMAIL}'")
    step(D.PHONE, f"'{D.TOKEN_PHONE}'")
    step(D.CARD, f"'{D.TOKEN_CARD}'")
    step(D.BOOKING_CODE, f"'{D.TOKEN_BOOKING}'", "gi")
    step(D.TICKET, f"'{D.TOKEN_TICKET}'")
    step(D.FLIGHT, f"'{D.FLIGHT_PREFIX}' || '\\1>'", "gi")
    step(D.HANDLE, "chr(1) || '\\1' || chr(2)")
    step("\\x01delta\\x02", "'@Delta'", "gi")
    step(marked, f"'{D.TOKEN_HANDLE}'")
    tables = ["m0 AS (SELECT doc_id, text AS x FROM documents)"]
    tables += [f"{n} AS (SELECT doc_id, {e} AS x FROM {src})" for n, src, e in steps[1:]]
    return "WITH " + ",\n".join(tables) + "\n" + select


def _count(table: str, pattern: str, flags: str = "") -> str:
    return (
        f"(SELECT sum(len(regexp_extract_all(x, '{flags}{pattern}')))::bigint FROM {table})"
    )


def _masked_totals(s, d):
    counts = mask_steps(F.col("text"), MASK)[1]
    return X.table(s, d, "documents").agg(
        *[F.sum(counts[k].cast("long")).alias(k) for k in KINDS]
    )


SQL_TYPE = f"""CASE WHEN regexp_matches(text, '{CANNED["dm"][0]}', 'i') AND {sql_words("text")} <= 60
    THEN 'pure_dm_deflection'
  WHEN regexp_matches(text, '{CANNED["dm"][0]}', 'i') THEN 'partial_dm_deflection'
  WHEN regexp_matches(text, '{CANNED["acknowledgement"][0]}', 'i') AND {sql_words("text")} <= 50
    THEN 'generic_acknowledgment'
  ELSE 'substantive_contextual' END"""


def _guard_sql() -> str:
    category = "\n".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in GUARD)
    phrase = "\n".join(
        f"WHEN regexp_matches(text, '{p}') THEN regexp_extract(text, '{p}', 2)" for n, p in GUARD
    )
    return (
        f"SELECT doc_id, CASE {category} END AS category, CASE {phrase} END AS phrase FROM documents"
    )


GOLD_RULES = (
    (("thnd", "ither", "ouse"), 1, "URGENT", "found ({}) in text"),
    (("erin and", "ible"), 1, "DISRUPTION", "second rule"),
    (("thre",), 0, "GENERAL", "third rule"),
    (("zu", "qu"), 0, "LOYALTY", "fourth rule"),
)
ROUTER = (
    (("thnd", "erin"), "first intent", "first reply", False),
    (("thre", "qu"), "second intent", "second reply", True),
    (("zu",), "third intent", "third reply", False),
)
ROUTER_DEFAULT = ("other intent", "other reply", False)


def _sql_contains(words, column="lower(text)") -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _gold_sql() -> str:
    first = GOLD_RULES[0][0]
    found = "array_to_string([x for x in [" + ", ".join(
        f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in first
    ) + "] if x IS NOT NULL], ', ')"
    short = f"contains(text, '.') AND {sql_words('lower(text)')} <= 12 AND NOT " + _sql_contains(
        D.GOLD_NEGATIVE_WORDS
    )
    rows = [(_sql_contains(w), e, i, f"'{r}'") for w, e, i, r in GOLD_RULES]
    rows[0] = (*rows[0][:3], f"'found (' || {found} || ') in text'")
    rows.append((short, D.GOLD_SHORT[0], D.GOLD_SHORT[1], f"'{D.GOLD_SHORT[2]}'"))

    def case(pick, default) -> str:
        return "CASE " + " ".join(f"WHEN {r[0]} THEN {pick(r)}" for r in rows) + f" ELSE {default} END"

    return f"""SELECT doc_id, {case(lambda r: r[1], D.GOLD_OPEN[0])} AS escalate,
{case(lambda r: f"'{r[2]}'", f"'{D.GOLD_OPEN[1]}'")} AS intent,
{case(lambda r: r[3], f"'{D.GOLD_OPEN[2]}'")} AS rationale FROM documents"""


RUBRIC = J.RubricWords(
    emergency=("thble", "worthless"), escalated=("thnd",), safe=("ouer",),
    overpromise=("ingth", "zu"), address=("The", "En"), channel=("th", "la", "der"),
    action=("There", "Ing", "Er"), kind=("and", "und", "et"), penalty_words=150,
)


def _judge_sql() -> str:
    w, t = RUBRIC, D.RUBRIC_TEXT
    q, r = "lower(query)", "lower(reply)"
    urgent = _sql_contains(w.emergency, q)

    def case(rows, default, part) -> str:
        show = (lambda x: f"'{x}'") if part else (lambda x: f"{x}::double")
        body = " ".join(f"WHEN {c} THEN {show(t[n][part])}" for c, n in rows)
        return f"CASE {body} ELSE {show(t[default][part])} END"

    safety = [
        (f"{urgent} AND (esc OR {_sql_contains(w.escalated, r)})", "emergency_escalated"),
        (urgent, "emergency_missed"), ("esc AND should", "claim_escalated"),
        ("NOT esc AND NOT should", "self_service"),
    ]
    ground = [
        (f"esc OR {_sql_contains(w.safe, r)}", "safe_routing"),
        (_sql_contains(w.overpromise, r), "overpromise"),
        (f"{_sql_contains(w.address, 'reply')} AND {_sql_contains(w.channel, r)}", "grounded"),
    ]
    action = [(_sql_contains(w.action, "reply"), "action")]
    tone = [(_sql_contains(w.kind, r), "kind")]
    return f"""WITH pairs AS (
  SELECT u.conv_id, u.turn, u.text AS query, a.text AS reply, u.conv_id % 3 = 0 AS esc,
    u.conv_id % 2 = 0 AS should
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
scored AS (SELECT conv_id, turn,
  {case(safety, 'misrouted', 0)} AS safety_compliance, {case(ground, 'vague', 0)} AS factual_grounding,
  {case(action, 'no_action', 0)} AS actionability, {case(tone, 'dry', 0)} AS tone_empathy,
  {sql_words('reply')} AS word_count,
  'SE: ' || {case(safety, 'misrouted', 1)} || ' | FG: ' || {case(ground, 'vague', 1)} || ' | AC: '
    || {case(action, 'no_action', 1)} AS rationale FROM pairs)
SELECT *, round((safety_compliance * 0.35::double + factual_grounding * 0.30::double
  + actionability * 0.20::double + tone_empathy * 0.15::double
  - least(0.4::double, greatest(word_count - {w.penalty_words}, 0) * 0.01::double))::varchar::decimal(20, 16), 2)::double
  AS overall
FROM scored"""


def reply_pairs(s, d):
    c = X.table(s, d, "conversations")
    ask = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    answer = c.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    return ask.join(answer, ["conv_id", "turn"])


def _judged(s, d):
    scores = J.judge(
        F.col("query"), F.col("reply"), F.col("conv_id") % 3 == 0, F.col("conv_id") % 2 == 0,
        words=RUBRIC,
    )
    rows = reply_pairs(s, d).withColumn("j", scores)
    return rows.select(
        "conv_id", "turn", "j.safety_compliance", "j.factual_grounding", "j.actionability",
        "j.tone_empathy", "j.word_count", "j.rationale",
        F.col("j.overall_score").alias("overall"),
    )


def conversation_turns(s, d):
    """Turn rows of conversations; system turns are the brand's, as in ``fixtures.conversation_posts``."""
    kind = F.when(F.col("role") != "user", R.canned_type(F.col("text"), **CANNED))
    return (
        X.table(s, d, "conversations")
        .select(
            "conv_id",
            F.col("turn").alias("turn_index"),
            F.when(F.col("role") == "user", "customer").otherwise("brand").alias("speaker"),
            F.col("text").alias("scrubbed_text"),
            R.is_canned(kind).alias("is_canned"),
        )
    )


THREAD_RULES = T.ThreadRules(mask=MASK, canned=CANNED)


def conversation_threads(s, d):
    """Assembled threads of conversations."""
    return T.reconstruct_threads(linear(s, d), THREAD_RULES)


SQL_SCRUB = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
SQL_SPOKEN = f"""spoken AS (
  SELECT conv_id, turn, role = 'user' AS customer, text, {sql_words('text')} AS words,
    role <> 'user' AND {SQL_TYPE} <> 'substantive_contextual' AS canned
  FROM conversations),
opened AS (SELECT *, min(turn) FILTER (NOT customer) OVER (PARTITION BY conv_id) AS fb FROM spoken),
judged AS (SELECT conv_id, count(*) AS num_turns, any_value(fb) AS fb,
  count(*) FILTER (customer AND turn > fb) AS later,
  coalesce(bool_or(regexp_matches(text, '{THANKS}')) FILTER (customer AND turn > fb), false) AS thanks,
  coalesce(bool_or(regexp_matches(text, '{ANGER}')) FILTER (customer AND turn > fb), false) AS anger,
  any_value(words) FILTER (turn = fb) AS fw, any_value(canned) FILTER (turn = fb) AS fc,
  count(*) FILTER (canned) = count(*) FILTER (NOT customer) AND count(*) FILTER (NOT customer) > 0 AS pure,
  arg_min(text, turn) AS inquiry, coalesce(any_value(text) FILTER (turn = fb), '') AS reply,
  max(turn) AS leaf, min(turn) AS root
  FROM opened GROUP BY conv_id),
labelled AS (SELECT *, CASE WHEN pure THEN 'DEFLECTED_UNVERIFIED' WHEN fb IS NULL THEN 'NO_BRAND_REPLY'
  WHEN thanks AND NOT anger THEN 'EXPLICIT_SUCCESS' WHEN anger THEN 'FAILED_ESCALATION'
  WHEN later = 0 AND fw >= 15 AND NOT fc THEN 'IMPLICIT_SUCCESSFUL_CLOSURE'
  WHEN later = 0 THEN 'AMBIGUOUS_SILENT_CLOSURE' ELSE 'MULTI_TURN_CONVERSATIONAL' END
    AS resolution_label FROM judged),
scored AS (SELECT *, CASE resolution_label WHEN 'DEFLECTED_UNVERIFIED' THEN 0.2::double
  WHEN 'NO_BRAND_REPLY' THEN 0.0::double WHEN 'EXPLICIT_SUCCESS' THEN 0.95::double
  WHEN 'FAILED_ESCALATION' THEN 0.1::double WHEN 'IMPLICIT_SUCCESSFUL_CLOSURE' THEN 0.75::double
  WHEN 'AMBIGUOUS_SILENT_CLOSURE' THEN 0.4::double ELSE 0.6::double END AS resolution_score
  FROM labelled)"""
PATTERNS = {"gratitude": THANKS, "frustration": ANGER}


def _labels(s, d):
    t = S.label_resolution(conversation_threads(s, d), **PATTERNS)
    return t.select(
        "thread_id", "num_turns", "resolution.resolution_score", "resolution.resolution_label",
        F.col("resolution.signals.has_gratitude").alias("thanks"),
        F.col("resolution.signals.has_frustration").alias("anger"),
        F.size(T.turns_after_brand(F.col("turns"))).alias("later"),
    )


def _heads(s, d):
    t = T.first_customer_turn(conversation_threads(s, d), 4)
    return t.select("thread_id", "inquiry", "customer_inquiry_text", "initial_brand_reply")


def _kb(s, d):
    return S.build_kb(conversation_threads(s, d), **PATTERNS)


ENTRIES = {
    "pii_scrub": (
        lambda s, d: X.table(s, d, "documents").select(
            "doc_id", scrub(F.col("text"), MASK).alias("masked")
        ),
        _mask_sql("SELECT doc_id, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS masked FROM m13"),
    ),
    "pii_counts": (
        lambda s, d: X.table(s, d, "conversations").select(
            "conv_id", "turn",
            F.coalesce(
                pii_counts(F.concat(F.lit("@a @Delta "), F.col("text"),
                                    F.lit(" https://t.co/x1 @b")), MASK)["handles"], F.lit(0)
            ).alias("handles"),
            F.coalesce(
                pii_counts(F.concat(F.lit("see http://delta.com/x "), F.col("text")), MASK)["urls"],
                F.lit(0),
            ).alias("urls"),
        ),
        "SELECT conv_id, turn, len(regexp_extract_all(text, '@[A-Za-z0-9_]+')) + 2 AS handles, "
        "len(regexp_extract_all(text, 'https?://')) + 1 AS urls FROM conversations",
    ),
    "pii_totals": (
        _masked_totals,
        _mask_sql(
            "SELECT " + ", ".join(
                f"{_count(t, p, f)} AS {k}"
                for k, t, p, f in (
                    ("urls", "m0", D.URL, ""), ("emails", "m4", D.EMAIL, ""),
                    ("phones", "m5", D.PHONE, ""), ("cards", "m6", D.CARD, ""),
                    ("pnrs", "m7", D.BOOKING_CODE, "(?i)"), ("tickets", "m8", D.TICKET, ""),
                    ("flights", "m9", D.FLIGHT, "(?i)"),
                    ("handles", "m12", "\\x01[^\\x02]*\\x02", ""),
                )
            )
        ),
    ),
    "split_signature": (
        lambda s, d: X.table(s, d, "conversations").select(
            "conv_id", "turn",
            split_signature(F.concat("text", F.lit(" "), F.expr(
                "element_at(array('*AB ', '^xyz', '-Jo', '/QQQQ', 'none', '-a'), "
                "cast(turn % 6 + 1 as int))"))).alias("c"),
        ).select("conv_id", "turn", "c.signature", F.md5("c.rest").alias("rest")),
        """WITH t AS (SELECT conv_id, turn, text || ' '
  || (['*AB ', '^xyz', '-Jo', '/QQQQ', 'none', '-a'])[turn % 6 + 1] AS x FROM conversations)
SELECT conv_id, turn, (['*AB', '^xyz', '-Jo', '/QQQQ', NULL, NULL])[turn % 6 + 1] AS signature,
  md5(CASE WHEN turn % 6 IN (4, 5) THEN x
    ELSE trim(regexp_replace(x, '[*^/-][A-Za-z]{1,4}\\s*$', ''), chr(32) || chr(9) || chr(10) || chr(13))
  END) AS rest FROM t""",
    ),
    "canned_type": (
        lambda s, d: X.table(s, d, "conversations").where("role = 'assistant'").select(
            "conv_id", "turn", R.canned_type(F.col("text"), **CANNED).alias("kind")
        ),
        f"SELECT conv_id, turn, {SQL_TYPE} AS kind FROM conversations WHERE role = 'assistant'",
    ),
    "guardrail_hits": (
        lambda s, d: X.table(s, d, "documents").select(
            "doc_id", R.guardrail(F.col("text"), GUARD, 2).alias("g")
        ).select("doc_id", "g.category", "g.phrase"),
        _guard_sql(),
    ),
    "intent_tags": (
        lambda s, d: X.table(s, d, "documents").select(
            "doc_id",
            F.array_join(R.tag_intents(F.col("text"), INTENTS, whole_words=True), ",").alias("tags"),
        ),
        "SELECT doc_id, array_to_string([x for x in ["
        + ", ".join(
            f"CASE WHEN regexp_matches(lower(text), '{word(w[0])[4:]}') THEN '{n}' END"
            for n, w in INTENTS
        )
        + "] if x IS NOT NULL], ',') AS tags FROM documents",
    ),
    "rule_classify": (
        lambda s, d: X.table(s, d, "documents").select(
            "doc_id", R.classify_inquiry(F.col("text"), GOLD_RULES, question_mark=".").alias("v")
        ).select("doc_id", "v.*"),
        _gold_sql(),
    ),
    "keyword_router": (
        lambda s, d: X.table(s, d, "documents").select(
            "doc_id", R.keyword_router(F.col("text"), ROUTER, ROUTER_DEFAULT).alias("r")
        ).select("doc_id", "r.*"),
        "SELECT doc_id, "
        + ", ".join(
            "CASE " + " ".join(f"WHEN {_sql_contains(w)} THEN {v}" for w, v in rows)
            + f" ELSE {default} END AS {name}"
            for name, rows, default in (
                ("intent", [(r[0], f"'{r[1]}'") for r in ROUTER], "'other intent'"),
                ("reply", [(r[0], f"'{r[2]}'") for r in ROUTER], "'other reply'"),
                ("escalate", [(r[0], str(r[3]).lower()) for r in ROUTER], "false"),
            )
        )
        + " FROM documents",
    ),
    "coarse_class": (
        lambda s, d: X.table(s, d, "orders").select(
            "o_orderkey",
            R.coarse_class(
                F.col("o_orderpriority"),
                (("TOP", ("URGENT", "HIGH")), ("MIDDLE", ("MEDIUM",)), ("REST", ("LOW",))), "NONE",
            ).alias("coarse"),
        ),
        "SELECT o_orderkey, CASE WHEN contains(o_orderpriority, 'URGENT') "
        "OR contains(o_orderpriority, 'HIGH') THEN 'TOP' WHEN contains(o_orderpriority, 'MEDIUM') "
        "THEN 'MIDDLE' WHEN contains(o_orderpriority, 'LOW') THEN 'REST' ELSE 'NONE' END AS coarse "
        "FROM orders",
    ),
    "template_reply": (
        lambda s, d: X.table(s, d, "documents").select(
            "doc_id",
            R.template_reply(
                F.col("source"), (("src1", "one"), ("src2", "two"), ("src3", "three")), "src3"
            ).alias("reply"),
        ),
        "SELECT doc_id, CASE source WHEN 'src1' THEN 'one' WHEN 'src2' THEN 'two' ELSE 'three' END "
        "AS reply FROM documents",
    ),
    "severity_tier": (
        lambda s, d: Y.tier_report(
            X.table(s, d, "orders").select(
                "o_orderkey",
                F.concat(
                    F.when(F.col("o_orderpriority").startswith("1"), "CRITICAL_").otherwise(""),
                    F.when(F.col("o_orderstatus") == "P", "LEGAL").otherwise("High"),
                ).alias("severity"),
            )
        ),
        "SELECT *, CASE WHEN severity LIKE '%CRITICAL%' OR severity LIKE '%LEGAL%' THEN "
        f"'{D.TIER0_NAME}' ELSE '{D.TIER1_NAME}' END AS primary_tier FROM (SELECT o_orderkey, "
        "CASE WHEN o_orderpriority LIKE '1%' THEN 'CRITICAL_' ELSE '' END || "
        "CASE WHEN o_orderstatus = 'P' THEN 'LEGAL' ELSE 'High' END AS severity FROM orders)",
    ),
    "latin_words": (
        lambda s, d: X.table(s, d, "conversations").select(
            "conv_id", "turn", F.array_join(latin_words(F.col("text")), " ").alias("words")
        ),
        "SELECT conv_id, turn, coalesce(array_to_string([x for x in "
        "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') if regexp_full_match(x, '[a-z]{2,}')], "
        "' '), '') AS words FROM conversations",
    ),
    "judge_scores": (_judged, _judge_sql()),
    "score_tiers": (
        lambda s, d: X.table(s, d, "part").select(
            "p_partkey", (F.col("p_size") / 10.0).cast("double").alias("score")
        ).withColumn("tier", J.score_tier(F.col("score"))),
        "SELECT p_partkey, (p_size / 10.0)::double AS score, CASE WHEN p_size < 30 THEN 'POOR' "
        "WHEN p_size < 43 THEN 'SATISFACTORY' ELSE 'EXCELLENT' END AS tier FROM part",
    ),
    "resolution_labels": (
        _labels,
        f"WITH {SQL_SPOKEN} SELECT 'delta_thread_' || (conv_id * 100 + root) AS thread_id, "
        "num_turns, resolution_score, resolution_label, thanks AND NOT pure AS thanks, "
        "anger AND NOT pure AS anger, later FROM scored WHERE num_turns >= 2 AND fb IS NOT NULL",
    ),
    "resolution_turns": (
        lambda s, d: S.resolve_turns(conversation_turns(s, d), ["conv_id"], **PATTERNS),
        f"WITH {SQL_SPOKEN} SELECT conv_id, resolution_score, resolution_label FROM scored",
    ),
    "label_distribution": (
        lambda s, d: S.label_distribution(_kb(s, d)).withColumn("pct", F.round("pct", 6)),
        f"""WITH {SQL_SPOKEN}, kb AS (SELECT * FROM scored WHERE num_turns >= 2 AND fb IS NOT NULL
  AND {sql_words('inquiry')} >= 4 AND {sql_words('reply')} >= 5)
SELECT resolution_label, count(*) AS pairs, round(count(*) / (SELECT count(*) FROM kb) * 100, 6) AS pct
FROM kb GROUP BY resolution_label""",
    ),
    "build_kb": (
        lambda s, d: _kb(s, d).select(
            "kb_id", "thread_id", F.md5("customer_inquiry").alias("inquiry"),
            F.md5("brand_reply").alias("reply"), "resolution_score", "resolution_label",
        ),
        f"""WITH {SQL_SPOKEN} SELECT conv_id * 100 + leaf AS kb_id,
  'delta_thread_' || (conv_id * 100 + root) AS thread_id,
  md5({SQL_SCRUB.format('inquiry')}) AS inquiry, md5({SQL_SCRUB.format('reply')}) AS reply,
  resolution_score, resolution_label FROM scored WHERE num_turns >= 2 AND fb IS NOT NULL
  AND {sql_words('inquiry')} >= 4 AND {sql_words('reply')} >= 5""",
    ),
    "thread_heads": (
        _heads,
        f"""WITH {SQL_SPOKEN}, asked AS (SELECT conv_id, arg_min(text, turn) AS ask FROM spoken
  WHERE customer GROUP BY 1)
SELECT 'delta_thread_' || (conv_id * 100 + root) AS thread_id, {SQL_SCRUB.format('ask')} AS inquiry,
  {SQL_SCRUB.format('inquiry')} AS customer_inquiry_text,
  {SQL_SCRUB.format('reply')} AS initial_brand_reply
FROM judged JOIN asked USING (conv_id) WHERE num_turns >= 2 AND fb IS NOT NULL
  AND {sql_words('ask')} >= 4""",
    ),
}
