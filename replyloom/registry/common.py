"""Fixture parameters and SQL fragments shared by the registered queries."""

from __future__ import annotations

from replyloom import fixtures as X

BRANDS = tuple(f"brand{i}" for i in range(5))


def word(words: str) -> str:
    """Pattern for whole words, the same in every engine: one of ``a|b|c`` between non-letters."""
    return rf"(?i)(^|[^\p{{L}}])({words})($|[^\p{{L}}])"


# Words that occur in the bundled tables, in the roles the default lists play for real posts.
GUARD = tuple(
    (f"CATEGORY_{i}", word(w))
    for i, w in enumerate(("worthless", "license", "thble", "thnd", "thor"), 1)
)
INTENTS = tuple((f"INTENT_{w.upper()}", (w,)) for w in
                ("ther", "thon", "thth", "thre", "thes", "thed", "erin"))
THANKS = word("from|with")
ANGER = word("was|are")
CANNED = {
    "dm": (r"(^|[^\p{L}])(that|this)($|[^\p{L}])",),
    "acknowledgement": (r"(^|[^\p{L}])(and|the|der|la)($|[^\p{L}])",),
    "dm_words": 60,
    "acknowledgement_words": 50,
}
#: words of a text, split at whitespace
SQL_WORDS = "len([x for x in regexp_split_to_array({0}, '\\s+') if x <> ''])"


def sql_words(expression: str) -> str:
    return SQL_WORDS.format(expression)


SQL_BRANCHING = """posts AS (
  SELECT conv_id * 100 + turn AS tweet_id,
         CASE WHEN role = 'user' THEN 'user' || conv_id ELSE 'brand' || (conv_id % 5) END AS author_id,
         role = 'user' AS inbound, text,
         CASE WHEN turn <> 0 THEN conv_id * 100 + (turn - 1) // 2 END AS in_reply_to
  FROM conversations)"""
SQL_LINEAR = SQL_BRANCHING.replace("(turn - 1) // 2", "turn - 1")
SQL_EVENTS = """chained AS (
  SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous
  FROM events),
posts AS (
  SELECT event_id AS tweet_id, 'user' || user_id AS author_id,
         event_type IN ('click', 'view', 'error') AS inbound, ts AS created_at,
         '@user' || user_id || ' ' || event_type || ' ' || props || ' ^'
           || upper(substr(event_type, 1, 2)) AS text,
         CASE WHEN event_type <> 'signup' THEN previous END AS in_reply_to
  FROM chained)"""
SQL_PATHS = """walk AS (
  SELECT tweet_id AS root_id, tweet_id, [tweet_id] AS path FROM posts
  WHERE in_reply_to IS NULL OR in_reply_to NOT IN (SELECT tweet_id FROM posts)
  UNION ALL
  SELECT w.root_id, c.tweet_id, list_append(w.path, c.tweet_id)
  FROM walk w JOIN posts c ON c.in_reply_to = w.tweet_id),
leaves AS (
  SELECT root_id, tweet_id AS leaf_id, path, len(path) AS depth FROM walk
  WHERE tweet_id NOT IN (SELECT in_reply_to FROM posts WHERE in_reply_to IS NOT NULL))"""

branching = lambda s, d: X.conversation_posts(s, d, "branching")
linear = lambda s, d: X.conversation_posts(s, d, "linear")
