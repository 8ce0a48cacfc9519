"""Selection, ids, brand corpora and brand profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from replyloom import fixtures as X
from replyloom.functions.text import is_bare_numeric, word_count
from replyloom.operators import posts as P
from replyloom.operators import profile as B
from replyloom.registry.common import (
    BRANDS, SQL_BRANCHING, SQL_LINEAR, branching, linear, sql_words, word,
)
from replyloom.sources.threads import compact_sample

SIGNATURE = r"(\^[A-Za-z]{1,4}|-[A-Za-z]{2,4}|/[A-Za-z]{2,4})"
DEFLECT = word("that|this|von")
SQL_TOKENS = (
    "[x for x in regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') "
    "if regexp_full_match(x, '[a-z]{2,}')]"
)

SQL_CORPUS = f"""own AS (SELECT author_id AS brand, * REPLACE (false AS inbound) FROM posts
        WHERE author_id LIKE 'brand%'),
needed AS (SELECT DISTINCT brand, in_reply_to AS tweet_id FROM own WHERE in_reply_to IS NOT NULL),
corpus AS (SELECT * FROM own
  UNION ALL
  SELECT n.brand, p.* FROM posts p JOIN needed n ON p.tweet_id = n.tweet_id
  WHERE p.author_id <> n.brand)"""

SQL_PROFILE = f"""WITH RECURSIVE {SQL_LINEAR}, {SQL_CORPUS},
walk AS (
  SELECT c.brand, c.tweet_id AS root_id, c.tweet_id, 1 AS depth,
         CASE WHEN NOT inbound THEN nullif(regexp_extract(text, '{SIGNATURE}', 1), '') END AS lo,
         CASE WHEN NOT inbound THEN nullif(regexp_extract(text, '{SIGNATURE}', 1), '') END AS hi
  FROM corpus c
  WHERE in_reply_to IS NULL
     OR NOT EXISTS (SELECT 1 FROM corpus q WHERE q.brand = c.brand AND q.tweet_id = c.in_reply_to)
  UNION ALL
  SELECT w.brand, w.root_id, c.tweet_id, w.depth + 1,
         least(w.lo, CASE WHEN NOT c.inbound THEN nullif(regexp_extract(c.text, '{SIGNATURE}', 1), '') END),
         greatest(w.hi, CASE WHEN NOT c.inbound THEN nullif(regexp_extract(c.text, '{SIGNATURE}', 1), '') END)
  FROM walk w JOIN corpus c ON c.brand = w.brand AND c.in_reply_to = w.tweet_id),
leaf AS (SELECT * FROM walk w WHERE NOT EXISTS
  (SELECT 1 FROM corpus q WHERE q.brand = w.brand AND q.in_reply_to = w.tweet_id)),
root AS (SELECT brand, root_id, count(*) AS n, bool_or(coalesce(lo <> hi, false)) AS handed
  FROM leaf GROUP BY 1, 2),
shape AS (SELECT brand, count(*) AS paths, avg(depth) AS a, median(depth) AS m, max(depth) AS x,
    avg(CASE WHEN depth >= 3 THEN 100.0 ELSE 0 END) AS d3,
    avg(CASE WHEN depth >= 4 THEN 100.0 ELSE 0 END) AS d4 FROM leaf GROUP BY 1),
hand AS (SELECT brand, sum(handed::int) / sum(n) * 100 AS h FROM root GROUP BY 1),
sent AS (SELECT *, {SQL_TOKENS} AS w FROM corpus WHERE NOT inbound),
grams AS (SELECT brand, unnest(list_zip(w[1:len(w)-1], w[2:])) AS g FROM sent WHERE len(w) > 1),
sigs AS (SELECT brand, count(DISTINCT s) AS n FROM
  (SELECT brand, unnest(regexp_extract_all(text, '{SIGNATURE}')) AS s FROM sent) GROUP BY 1)
SELECT o.brand, count(*) AS outbound_replies, any_value(paths) AS reconstructed_threads,
  round(any_value(a), 2) AS avg_thread_depth, round(any_value(m), 1) AS median_thread_depth,
  any_value(x) AS max_thread_depth, round(any_value(d3), 2) AS pct_depth_ge_3,
  round(any_value(d4), 2) AS pct_depth_ge_4,
  round(avg(CASE WHEN regexp_matches(text, '{DEFLECT}') THEN 100.0 ELSE 0 END), 2)
    AS dm_deflection_rate_pct,
  round(any_value((SELECT count(DISTINCT g) / count(*) FROM grams g WHERE g.brand = o.brand)), 4)
    AS distinct_2_bigram_ratio,
  coalesce(any_value(sigs.n), 0) AS unique_agent_sigs,
  round(any_value(h), 2) AS handoff_threads_pct
FROM sent o JOIN shape USING (brand) JOIN hand USING (brand) LEFT JOIN sigs USING (brand)
GROUP BY o.brand"""


def _ratio(n: int) -> str:
    gram = "unnest(w)" if n == 1 else "unnest(list_zip(w[1:len(w)-1], w[2:]))"
    return f"""SELECT brand, count(DISTINCT g) AS unique_grams, count(*) AS total_grams,
  round(count(DISTINCT g) / count(*), 6) AS distinct_ratio
FROM (SELECT brand, {gram} AS g FROM (SELECT source AS brand, {SQL_TOKENS} AS w FROM documents))
GROUP BY brand"""


def _distinct(n: int):
    def run(s, d):
        docs = X.document_posts(s, d).withColumnRenamed("author_id", "brand")
        return B.distinct_n(docs, ["brand"], n).withColumn(
            "distinct_ratio", F.round("distinct_ratio", 6)
        )

    return run


def _repeated(s, d):
    # every post once as it is, and posts of users once more with a later, upper-case text
    posts = branching(s, d)
    first = posts.withColumn("seq", F.lit(1))
    again = posts.where("inbound").withColumns(
        {"seq": F.lit(2), "text": F.upper("author_id")}
    )
    return first.unionByName(again)


ENTRIES = {
    "brand_posts": (
        lambda s, d: P.brand_posts(branching(s, d), BRANDS[:2]).select("tweet_id", "author_id"),
        f"WITH {SQL_BRANCHING} SELECT tweet_id, author_id FROM posts "
        "WHERE author_id IN ('brand0', 'brand1')",
    ),
    "outbound_posts": (
        lambda s, d: P.outbound(branching(s, d)).groupBy("author_id").agg(
            F.count(F.lit(1)).alias("posts")
        ),
        f"WITH {SQL_BRANCHING} SELECT author_id, count(*) AS posts FROM posts WHERE NOT inbound "
        "GROUP BY author_id",
    ),
    "normalise_ids": (
        lambda s, d: P.normalise_ids(
            branching(s, d).select(
                "tweet_id",
                F.coalesce(F.col("in_reply_to").cast("double").cast("string"), F.lit("NaN")).alias(
                    "in_reply_to"
                ),
            ),
            "in_reply_to",
        ),
        f"WITH {SQL_BRANCHING} SELECT tweet_id, in_reply_to FROM posts",
    ),
    "dedupe_posts": (
        lambda s, d: P.dedupe_posts(_repeated(s, d), "seq").select("tweet_id", "seq", "text"),
        f"WITH {SQL_BRANCHING} SELECT tweet_id, CASE WHEN inbound THEN 2 ELSE 1 END AS seq, "
        "CASE WHEN inbound THEN upper(author_id) ELSE text END AS text FROM posts",
    ),
    "needed_parents": (
        lambda s, d: P.needed_parents(P.brand_posts(branching(s, d), BRANDS)),
        f"WITH {SQL_BRANCHING} SELECT DISTINCT in_reply_to AS tweet_id FROM posts "
        "WHERE author_id LIKE 'brand%' AND in_reply_to IS NOT NULL",
    ),
    "parents_of": (
        lambda s, d: P.parents_of(
            branching(s, d), P.brand_posts(branching(s, d), BRANDS)
        ).select("tweet_id", "author_id", "inbound"),
        f"WITH {SQL_BRANCHING} SELECT tweet_id, author_id, inbound FROM posts WHERE tweet_id IN "
        "(SELECT in_reply_to FROM posts WHERE author_id LIKE 'brand%')",
    ),
    "brand_corpus": (
        lambda s, d: P.brand_corpus(branching(s, d), BRANDS).select(
            "brand", "tweet_id", "author_id", "inbound", "in_reply_to"
        ),
        f"WITH {SQL_BRANCHING}, {SQL_CORPUS} "
        "SELECT brand, tweet_id, author_id, inbound, in_reply_to FROM corpus",
    ),
    "brand_volume": (
        lambda s, d: P.brand_volume(X.document_posts(s, d), 15),
        "SELECT source AS brand, count(*) AS replies, (SELECT count(*) FROM documents) AS total_posts "
        "FROM documents GROUP BY source ORDER BY replies DESC, brand LIMIT 15",
    ),
    "deflection_rate": (
        lambda s, d: B.deflection_rate(
            X.document_posts(s, d).withColumnRenamed("author_id", "brand"), ["brand"], DEFLECT
        ).withColumn("deflection_rate", F.round("deflection_rate", 6)),
        f"SELECT source AS brand, count(*) AS texts, "
        f"round(avg(regexp_matches(text, '{DEFLECT}')::int), 6) AS deflection_rate "
        "FROM documents GROUP BY source",
    ),
    "distinct_words": (_distinct(1), _ratio(1)),
    "distinct_bigrams": (_distinct(2), _ratio(2)),
    "agent_signatures": (
        lambda s, d: B.signature_counts(
            X.document_posts(s, d).withColumnRenamed("author_id", "brand"), ["brand"], SIGNATURE
        ),
        f"SELECT brand, count(DISTINCT s) AS unique_agent_sigs FROM (SELECT source AS brand, "
        f"unnest(regexp_extract_all(text, '{SIGNATURE}')) AS s FROM documents) GROUP BY brand",
    ),
    "brand_profile": (
        lambda s, d: B.profile_brands(linear(s, d), BRANDS, DEFLECT, SIGNATURE),
        SQL_PROFILE,
    ),
    "word_counts": (
        lambda s, d: X.table(s, d, "conversations").select(
            "conv_id", "turn", word_count(F.col("text")).alias("words")
        ),
        f"SELECT conv_id, turn, {sql_words('text')} AS words FROM conversations",
    ),
    "bare_numeric": (
        lambda s, d: X.table(s, d, "lineitem").select(
            "l_orderkey", "l_linenumber",
            *[
                is_bare_numeric(c).alias(n)
                for c, n in (
                    (F.col("l_quantity").cast("string"), "quantity_is_number"),
                    (F.concat_ws("-", "l_linenumber", F.col("l_suppkey") % 20), "pair_is_number"),
                    (F.concat("l_returnflag", "l_linestatus"), "word_is_number"),
                )
            ],
        ),
        """SELECT l_orderkey, l_linenumber, true AS quantity_is_number,
  length(l_linenumber || '-' || (l_suppkey % 20)) <= 3 AS pair_is_number,
  false AS word_is_number FROM lineitem""",
    ),
    "compact_sample": (
        lambda s, d: compact_sample(
            X.table(s, d, "documents").select("doc_id", "source"), ["doc_id"], 500
        ),
        "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 500",
    ),
}
