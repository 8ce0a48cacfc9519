"""Reply graph, turns, flags and assembled threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from replyloom import fixtures as X
from replyloom.functions.privacy import MaskRules
from replyloom.operators import graph as G
from replyloom.operators import posts as P
from replyloom.operators import profile as B
from replyloom.operators import threads as T
from replyloom.operators.gold import showcase
from replyloom.registry.common import (
    BRANDS, CANNED, SQL_BRANCHING, SQL_EVENTS, SQL_LINEAR, SQL_PATHS, branching, linear, sql_words,
)

#: ASCII word classes, for the comparison with SQL
MASK = MaskRules(flags="")
RULES = T.ThreadRules(mask=MASK, signature=r"(\^[A-Za-z]{1,4})\s*$", canned=CANNED)
EVENT_RULES = T.ThreadRules(
    mask=MASK,
    signature=r"(\^[A-Za-z]{1,4})\s*$",
    canned={"dm": ("signup",), "acknowledgement": ("4[0-9]",)},
)

SQL_EVENT_TURNS = f"""WITH RECURSIVE {SQL_EVENTS}, {SQL_PATHS},
turns AS (
  SELECT l.root_id, l.leaf_id, l.depth, m.i - 1 AS turn_index, p.tweet_id, p.inbound, p.text,
    CASE WHEN NOT p.inbound THEN nullif(regexp_extract(p.text, '(\\^[A-Za-z]{{1,4}})\\s*$', 1), '')
      END AS signature,
    CASE WHEN NOT p.inbound THEN rtrim(regexp_replace(p.text, '(\\^[A-Za-z]{{1,4}})\\s*$', ''))
      ELSE p.text END AS rest,
    CASE WHEN p.inbound THEN NULL
      WHEN regexp_matches(p.text, 'signup') AND {sql_words('p.text')} <= 25 THEN 'pure_dm_deflection'
      WHEN regexp_matches(p.text, 'signup') THEN 'partial_dm_deflection'
      WHEN regexp_matches(p.text, '4[0-9]') AND {sql_words('p.text')} <= 15
        THEN 'generic_acknowledgment'
      ELSE 'substantive_contextual' END AS macro_type,
    floor(greatest((epoch_us(p.created_at) - epoch_us(q.created_at)) / 1e6 / 3600.0, 0.0) * 100 + 0.5)
      / 100 AS gap
  FROM leaves l, unnest(range(1, l.depth + 1)) AS m(i)
  JOIN posts p ON p.tweet_id = l.path[m.i]
  LEFT JOIN posts q ON q.tweet_id = p.in_reply_to),
masked AS (SELECT *, trim(regexp_replace(regexp_replace(rest, '@[A-Za-z0-9_]+',
    '<CUSTOMER_HANDLE>', 'g'), '\\s+', ' ', 'g')) AS scrubbed_text FROM turns)"""

SQL_EVENT_FLAGS = """SELECT root_id AS root_tweet_id, leaf_id AS leaf_tweet_id, depth AS num_turns,
  count(*) FILTER (NOT inbound) AS brand_turns,
  count(*) FILTER (coalesce(macro_type, 'substantive_contextual') <> 'substantive_contextual')
    AS canned_turns,
  max(gap) AS max_gap_hours, count(DISTINCT signature) >= 2 AS multi_agent_handoff,
  coalesce(max(gap) >= 24.0, false) AS temporal_gap_gt_24h,
  count(*) FILTER (coalesce(macro_type, 'substantive_contextual') <> 'substantive_contextual')
    = count(*) FILTER (NOT inbound) AS is_pure_canned_deflection"""


def _assembled(s, d):
    t = T.reconstruct_threads(X.event_posts(s, d), EVENT_RULES)
    return t.select(
        "thread_id", "root_tweet_id", "leaf_tweet_id", "num_turns", "customer_inquiry_text",
        "initial_brand_reply",
        F.array_join(F.transform("turns", lambda x: x["tweet_id"].cast("string")), ",").alias("ids"),
        F.array_join("metadata.agent_signatures", ",").alias("signatures"),
        F.col("metadata.flags.multi_agent_handoff").alias("multi_agent_handoff"),
        F.col("metadata.flags.temporal_gap_gt_24h").alias("temporal_gap_gt_24h"),
        F.col("metadata.flags.is_pure_canned_deflection").alias("is_pure_canned_deflection"),
    )


def _depth(s, d):
    stats = G.depth_stats(G.thread_leaves(branching(s, d)))
    return stats.select(
        "paths", "max_depth",
        *[F.round(c, 6).alias(c) for c in
          ("avg_depth", "median_depth", "pct_depth_ge_3", "pct_depth_ge_4")],
    )


#: what every n-th event says besides, one entity of each kind
ENTITIES = (
    ("urls", 5, "https://some.org/1"), ("flights", 7, "DL 123"), ("phones", 11, "202-555-1736"), ("cards", 13, "5111 1111 1111 1111"),
    ("pnrs", 17, "confirmation code ABC123"),
)


def _said(s, d):
    said = [F.when(F.col("tweet_id") % n == 0, F.lit(f"{text}, ")).otherwise("") for _, n, text in ENTITIES]
    return X.event_posts(s, d).withColumn("text", F.concat(*said, "text"))


def _summary(s, d):
    return T.cleaning_summary(_said(s, d), EVENT_RULES)


def _showcase(s, d):
    """The first two threads of each of the four categories, all of which occur."""
    threads = T.reconstruct_threads(_said(s, d), EVENT_RULES)
    return showcase(threads, 2).select("category", "rank", "root_tweet_id", "leaf_tweet_id")


SQL_SAID = " || ".join(f"CASE WHEN event_id % {n} = 0 THEN '{text}, ' ELSE '' END" for _, n, text in ENTITIES)
SQL_SAID_TURNS = SQL_EVENT_TURNS.replace("'@user' || user_id", f"{SQL_SAID} || '@user' || user_id")
SQL_KINDS = ", ".join(f"sum((tweet_id % {n} = 0)::int) AS {kind}" for kind, n, _ in ENTITIES)


def _handoffs(s, d):
    events = X.event_posts(s, d).withColumn(
        "_sig", F.when(~F.col("inbound"), F.upper(F.substring("text", -3, 3)))
    )
    leaves = G.thread_leaves(
        events,
        measures={
            "low_signature": (F.col("_sig"), "min"), "high_signature": (F.col("_sig"), "max"),
        },
    )
    return B.handoff_rate(leaves).withColumn(
        "handoff_threads_pct", F.round("handoff_threads_pct", 6)
    )


ENTRIES = {
    "reply_edges": (
        lambda s, d: G.reply_edges(branching(s, d)),
        f"WITH {SQL_BRANCHING} SELECT p.tweet_id AS parent_id, c.tweet_id AS child_id "
        "FROM posts c JOIN posts p ON c.in_reply_to = p.tweet_id",
    ),
    "thread_roots": (
        # an opening post of a user answers a post that is not in the table
        lambda s, d: G.thread_roots(
            branching(s, d).withColumn(
                "in_reply_to",
                F.coalesce("in_reply_to", F.when(F.col("inbound"), F.col("tweet_id") + 99)),
            )
        ).select("tweet_id", "author_id", "in_reply_to"),
        f"WITH {SQL_BRANCHING} SELECT tweet_id, author_id, CASE WHEN inbound THEN tweet_id + 99 END "
        "AS in_reply_to FROM posts WHERE in_reply_to IS NULL "
        "OR in_reply_to NOT IN (SELECT tweet_id FROM posts)",
    ),
    "ancestor_closure": (
        lambda s, d: G.ancestor_closure(
            linear(s, d), P.brand_posts(linear(s, d), BRANDS[:1]), 3
        ).select("tweet_id", "author_id"),
        f"""WITH RECURSIVE {SQL_LINEAR}, hops AS (
  SELECT tweet_id, in_reply_to, 0 AS hop FROM posts WHERE author_id = 'brand0'
  UNION SELECT p.tweet_id, p.in_reply_to, h.hop + 1 FROM hops h
  JOIN posts p ON p.tweet_id = h.in_reply_to WHERE h.hop < 3)
SELECT tweet_id, author_id FROM posts WHERE tweet_id IN (SELECT tweet_id FROM hops)""",
    ),
    "reply_paths": (
        lambda s, d: G.path_members(branching(s, d)),
        f"""WITH RECURSIVE {SQL_BRANCHING}, {SQL_PATHS}
SELECT root_id, leaf_id, depth, (m.i - 1)::int AS position, path[m.i] AS tweet_id
FROM leaves, unnest(range(1, depth + 1)) AS m(i)""",
    ),
    "thread_leaves": (
        lambda s, d: G.thread_leaves(X.event_posts(s, d)),
        f"WITH RECURSIVE {SQL_EVENTS}, {SQL_PATHS} SELECT root_id, leaf_id, depth FROM leaves",
    ),
    "thread_depth": (
        _depth,
        f"""WITH RECURSIVE {SQL_BRANCHING}, {SQL_PATHS}
SELECT count(*) AS paths, max(depth) AS max_depth, round(avg(depth), 6) AS avg_depth,
  round(median(depth), 6) AS median_depth,
  round(avg(CASE WHEN depth >= 3 THEN 100.0 ELSE 0 END), 6) AS pct_depth_ge_3,
  round(avg(CASE WHEN depth >= 4 THEN 100.0 ELSE 0 END), 6) AS pct_depth_ge_4 FROM leaves""",
    ),
    "depth_shares": (
        lambda s, d: G.depth_stats(
            B.corpus_leaves(P.brand_corpus(branching(s, d), BRANDS)), ["brand"]
        ).select(
            "brand", "paths", F.round("pct_depth_ge_3", 6).alias("pct_depth_ge_3"),
            F.round("pct_depth_ge_4", 6).alias("pct_depth_ge_4"),
        ),
        f"""WITH RECURSIVE {SQL_BRANCHING},
own AS (SELECT author_id AS brand, * FROM posts WHERE author_id LIKE 'brand%'),
needed AS (SELECT DISTINCT brand, in_reply_to AS tweet_id FROM own),
corpus AS (SELECT * FROM own UNION ALL SELECT n.brand, p.* FROM posts p
  JOIN needed n ON p.tweet_id = n.tweet_id WHERE p.author_id <> n.brand),
walk AS (SELECT brand, tweet_id, 1 AS depth FROM corpus c WHERE NOT EXISTS
  (SELECT 1 FROM corpus q WHERE q.brand = c.brand AND q.tweet_id = c.in_reply_to)
  UNION ALL SELECT w.brand, c.tweet_id, w.depth + 1 FROM walk w
  JOIN corpus c ON c.brand = w.brand AND c.in_reply_to = w.tweet_id)
SELECT brand, count(*) AS paths,
  round(avg(CASE WHEN depth >= 3 THEN 100.0 ELSE 0 END), 6) AS pct_depth_ge_3,
  round(avg(CASE WHEN depth >= 4 THEN 100.0 ELSE 0 END), 6) AS pct_depth_ge_4
FROM walk w WHERE NOT EXISTS (SELECT 1 FROM corpus q WHERE q.brand = w.brand
  AND q.in_reply_to = w.tweet_id) GROUP BY brand""",
    ),
    "branching_threads": (
        lambda s, d: G.branching_threads(G.thread_leaves(branching(s, d))),
        f"WITH RECURSIVE {SQL_BRANCHING}, {SQL_PATHS} SELECT root_id, count(*) AS leaves "
        "FROM leaves GROUP BY root_id HAVING count(*) > 1",
    ),
    "handoff_rate": (
        _handoffs,
        f"""WITH RECURSIVE {SQL_EVENTS}, {SQL_PATHS},
signed AS (SELECT l.root_id, l.leaf_id, count(DISTINCT CASE WHEN NOT p.inbound
    THEN upper(right(p.text, 3)) END) AS agents
  FROM leaves l, unnest(l.path) AS m(id) JOIN posts p ON p.tweet_id = m.id GROUP BY 1, 2),
roots AS (SELECT root_id, count(*) AS n, bool_or(agents >= 2) AS handed FROM signed GROUP BY 1)
SELECT sum(handed::int)::bigint AS handoff_threads,
  round(sum(handed::int) / sum(n) * 100, 6) AS handoff_threads_pct FROM roots""",
    ),
    "turn_gaps": (
        lambda s, d: T.turn_gaps(X.event_posts(s, d)),
        f"""WITH {SQL_EVENTS} SELECT p.tweet_id,
  coalesce(floor(greatest((epoch_us(p.created_at) - epoch_us(q.created_at)) / 1e6 / 3600.0, 0.0)
    * 100 + 0.5) / 100, 0.0) AS gap_from_prev_hours, q.tweet_id IS NOT NULL AS has_gap
FROM posts p LEFT JOIN posts q ON q.tweet_id = p.in_reply_to""",
    ),
    "thread_turns": (
        lambda s, d: T.thread_turns(X.event_posts(s, d), EVENT_RULES).select(
            "root_tweet_id", "leaf_tweet_id", "turn_index", "tweet_id", "speaker", "signature",
            "scrubbed_text", "macro_type", "gap_from_prev_hours",
        ),
        SQL_EVENT_TURNS + """
SELECT root_id AS root_tweet_id, leaf_id AS leaf_tweet_id, turn_index::int AS turn_index, tweet_id,
  CASE WHEN inbound THEN 'customer' ELSE 'brand' END AS speaker, signature, scrubbed_text,
  macro_type, coalesce(gap, 0.0) AS gap_from_prev_hours FROM masked""",
    ),
    "thread_flags": (
        lambda s, d: T.thread_flags(X.event_posts(s, d), EVENT_RULES),
        SQL_EVENT_TURNS + SQL_EVENT_FLAGS
        + " FROM masked GROUP BY 1, 2, 3 HAVING depth >= 2 AND count(*) FILTER (NOT inbound) > 0",
    ),
    "thread_assembly": (
        _assembled,
        SQL_EVENT_TURNS + """
SELECT 'delta_thread_' || root_id AS thread_id, root_id AS root_tweet_id, leaf_id AS leaf_tweet_id,
  depth AS num_turns, arg_min(scrubbed_text, turn_index) AS customer_inquiry_text,
  coalesce(arg_min(scrubbed_text, turn_index) FILTER (NOT inbound), '') AS initial_brand_reply,
  string_agg(tweet_id::varchar, ',' ORDER BY turn_index) AS ids,
  coalesce(array_to_string(list_sort(list_distinct(list(signature))), ','), '') AS signatures,
  count(DISTINCT signature) >= 2 AS multi_agent_handoff,
  coalesce(max(gap) >= 24.0, false) AS temporal_gap_gt_24h,
  count(*) FILTER (coalesce(macro_type, 'substantive_contextual') <> 'substantive_contextual')
    = count(*) FILTER (NOT inbound) AS is_pure_canned_deflection
FROM masked GROUP BY root_id, leaf_id, depth
HAVING depth >= 2 AND count(*) FILTER (NOT inbound) > 0""",
    ),
    "cleaning_summary": (
        _summary,
        SQL_SAID_TURNS + ", flags AS (" + SQL_EVENT_FLAGS + f""", {SQL_KINDS},
  sum(len(regexp_extract_all(rest, '@[A-Za-z0-9_]+'))) AS handles
  FROM masked GROUP BY 1, 2, 3 HAVING depth >= 2 AND count(*) FILTER (NOT inbound) > 0)
SELECT count(*) AS total_threads, count(*) FILTER (multi_agent_handoff) AS multi_agent_handoffs,
  count(*) FILTER (temporal_gap_gt_24h) AS temporal_gap_gt_24h,
  count(*) FILTER (max_gap_hours >= 48) AS temporal_gap_gt_48h,
  count(*) FILTER (canned_turns > 0) AS contains_canned_macros,
  count(*) FILTER (is_pure_canned_deflection) AS pure_canned_deflection_threads,
  sum(urls)::bigint AS urls, sum(handles)::bigint AS handles, sum(pnrs)::bigint AS pnrs, sum(flights)::bigint AS flights,
  sum(phones)::bigint AS phones, sum(cards)::bigint AS cards,
  (SELECT count(*) FROM (SELECT 1 FROM flags GROUP BY root_tweet_id HAVING count(*) > 1))
    AS branching_threads
FROM flags""",
    ),
    "showcase": (
        _showcase,
        SQL_SAID_TURNS + ", flags AS (" + SQL_EVENT_FLAGS + """,
  bool_or(tweet_id % 7 = 0) AND bool_or(tweet_id % 17 = 0) AS pnr_flight
  FROM masked GROUP BY 1, 2, 3 HAVING depth >= 2 AND count(*) FILTER (NOT inbound) > 0),
named AS (SELECT *, unnest([CASE WHEN multi_agent_handoff THEN 'multi_agent_handoff' END,
  CASE WHEN temporal_gap_gt_24h THEN 'temporal_gap_gt_24h' END, CASE WHEN is_pure_canned_deflection THEN 'canned_deflection' END,
  CASE WHEN pnr_flight THEN 'pii_scrubbed_pnr_flight' END]) AS category FROM flags)
SELECT category, (row_number() OVER (PARTITION BY category ORDER BY root_tweet_id, leaf_tweet_id))::int AS rank, root_tweet_id, leaf_tweet_id
FROM named WHERE category IS NOT NULL QUALIFY rank <= 2""",
    ),
}
