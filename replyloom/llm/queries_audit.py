"""Registered queries of the filter audit, the vector codes and the URL filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from replyloom.llm.filter_audit import filter_audit
from replyloom.llm.url_filters import Rule, judge_urls, pattern_rule, rule_table, site_rule
from replyloom.llm.vector_codes import compressed_with_label_errors

#: Site rules that the contract fixes.
SITE_RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
]
#: Patterns for all other URLs: hosts of gambling, spam, adult pages and advertising, and paths of advertisements.
PATTERNS = [
    "||casino-", "||free-bets.", "||spam-", "||cheap-pills.", "||adult-", "||ads-", "||ads.", "||tracker.", "/ads/", "/banner/", "?utm_campaign=spam^", "||*-casino.", "@@||ads-txt.",
]


def url_rules() -> list[Rule]:
    return [site_rule(*r) for r in SITE_RULES] + [pattern_rule(p) for p in PATTERNS]


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(spark, f"{folder}/documents.parquet", spark.read.parquet(f"{folder}/labels.parquet"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return compressed_with_label_errors(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op13_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rule_table(spark, url_rules())).drop("url")


#: DuckDB SQL of op11: masks by a window over equal texts, then every order over every mask.
AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
      + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, good, toxic, mask, count(*) AS n FROM m GROUP BY ALL),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p AS (
  SELECT a.letter || b.letter || x.letter || y.letter || z.letter AS filter_order, [a.bit, b.bit, x.bit, y.bit, z.bit] AS bits
  FROM f a, f b, f x, f y, f z WHERE a.bit + b.bit + x.bit + y.bit + z.bit = 31 AND a.bit | b.bit | x.bit | y.bit | z.bit = 31),
o AS (
  SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS own, CAST(coalesce(list_sum(bits[1:k-1]), 0) AS INTEGER) AS before
  FROM (SELECT *, unnest(range(1, 6)) AS k FROM p)),
s AS (
  SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & own = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & own <> 0 AND good = 1 THEN n ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & own <> 0 AND toxic = 1 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, o GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM s"""


def _sql_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """DuckDB SQL of op12: every part against every entry, round by round."""
    ctes = [
        f"""k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS r
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""x AS MATERIALIZED (
  SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM (SELECT *, unnest(range(0, {parts})) AS p FROM k))""",
        f"""b0 AS MATERIALIZED (
  SELECT p, e, x.v FROM (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < {entries}) JOIN x USING (r))""",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (
  SELECT r, p, min(256 * CAST(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i]))) AS BIGINT) + e) AS m
  FROM x JOIN b{i} b USING (p) GROUP BY r, p)""")
        if i < rounds:
            ctes.append(f"""b{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{i} b LEFT JOIN (
    SELECT p, e, list(CASE WHEN s < 0 THEN -((c - 1 - s) // c) ELSE s // c END ORDER BY i) AS v
    FROM (
      SELECT p, m % 256 AS e, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS c
      FROM (SELECT p, m, v, unnest(range(1, len(v) + 1)) AS i FROM a{i} JOIN x USING (r, p)) GROUP BY ALL)
    GROUP BY p, e) n USING (p, e))""")
    return f"""
WITH {", ".join(ctes)},
g AS (
  SELECT vec_id, label, code, error FROM k JOIN (
    SELECT r, string_agg(lpad(lower(to_hex(m % 256)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error
    FROM a{rounds} GROUP BY r) USING (r)),
h AS (
  SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(v) AS c, unnest(range(1, len(v) + 1)) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM g, h"""


def _sql_urls() -> str:
    """DuckDB SQL of op13: every rule against every URL."""
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rules = ", ".join(f"({r.level}, {text(r.rule)}, {text(r.action)}, {text(r.regex)})" for r in url_rules())
    return rf"""
WITH u AS (
  SELECT page_id, row_number() OVER () AS row_id,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after FROM pages),
h AS (
  SELECT *, translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(after, length(regexp_extract(after, '^[^/?#]*')) + 1) AS tail FROM u),
r(level, rule, action, regex) AS (VALUES {rules}),
f AS (
  SELECT row_id, level, rule, action,
    row_number() OVER (PARTITION BY row_id ORDER BY level DESC,
      CASE WHEN level = 2 THEN length(rule) WHEN action = 'block' THEN 0 ELSE 1 END DESC,
      CASE WHEN level = 2 THEN instr(rule, '/') ELSE length(rule) END DESC, action DESC, rule DESC) AS place
  FROM h JOIN r ON after <> '' AND regexp_matches(host || tail, regex))
SELECT page_id, host, regexp_extract(tail, '^[^?#]*') AS path, CASE WHEN level = 2 THEN rule END AS rule,
  CASE WHEN level = 1 THEN rule END AS pattern, coalesce(action, 'allow') AS verdict
FROM h LEFT JOIN (SELECT * FROM f WHERE place = 1) USING (row_id)"""


ENTRIES = {
    "op11_filter_audit": (op11_filter_audit, AUDIT_SQL),
    "op12_vector_codes": (op12_vector_codes, _sql_codes()),
    "op13_url_filters": (op13_url_filters, _sql_urls()),
}
