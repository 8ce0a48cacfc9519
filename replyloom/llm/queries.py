"""Registered queries of the training-text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.llm.decontam import benchmark_hits
from replyloom.llm.html_extract import extract, fit_pages
from replyloom.llm.jaccard_join import similar_groups
from replyloom.llm.kd_shards import kd_shards
from replyloom.llm.langid import fit_profiles, identify
from replyloom.llm.packing import pack
from replyloom.llm.quality_rules import quality_verdicts
from replyloom.llm.queries_audit import ENTRIES as AUDIT
from replyloom.llm.secrets import ADDED, BASE, secret_spans, spans_text
from replyloom.llm.site_quality import site_quality
from replyloom.llm.toxicity import fit_toxicity, score_toxicity

#: Vocabulary of the packing query.
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def learn_toxicity(docs: DataFrame, labels: DataFrame):
    """Weights learned from the labels outside the held-out third."""
    return fit_toxicity(docs, labels, learn=_fold(3) != 1)


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, learn_toxicity(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    profiles = fit_profiles(docs, learn=_fold(4) != 2)
    found = identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_verdicts(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "rejected_by",
    )


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """The source stands for the host, the language below it for the path."""
    found = site_quality(
        table(spark, folder, "documents"), table(spark, folder, "labels"),
        host=F.col("source"), path=F.concat_ws("/", "source", "lang"),
    )
    return found.select("doc_id", "host", "path", "p_text", "p_site", "score", (F.col("score") >= 0.5).alias("keep"))


def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar_groups(table(spark, folder, "documents"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB SQL of op5: shingles met pairwise, then everything reachable.
SIMILAR_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT u AS doc_id, u AS other FROM l UNION SELECT r.doc_id, l.v FROM r JOIN l ON r.other = l.u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT doc_id, least(doc_id, min(other)) AS least FROM r GROUP BY doc_id) m USING (doc_id)"""


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), tokenizer_path())


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = kd_shards(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_spans(table(spark, folder, "documents"))
    base = F.filter("secret_spans", lambda s: s["place"] < len(BASE))

    def number(kind: str) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[number(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("secret_spans")).alias("spans"),
    )


def _sql_spans() -> str:
    """DuckDB SQL of op8: positions from the pieces between the matches."""
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS place, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, {p}) AS pieces, "
        f"regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {r.group}) AS gs FROM d"
        for i, r in enumerate(BASE + ADDED)
        for p in ["'" + r.pattern.replace("'", "''") + "'"]
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({kinds}),
x AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (
  SELECT doc_id, place, kind, len_of, b, b + len_of AS e FROM (
    SELECT doc_id, place, kind, length(ms[i]) AS len_of, length(gs[i]) >= least AS good,
      CAST(list_sum(list_transform(pieces[1:i], lambda p: length(p))) AS BIGINT)
        + CAST(coalesce(list_sum(list_transform(ms[1:i-1], lambda p: length(p))), 0) AS BIGINT) AS b
    FROM x)
  WHERE good),
g AS (
  SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access,
    count(*) FILTER (place = 2) AS n_hex,
    string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, place) FILTER (place < 3) AS base,
    string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, place) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


#: DuckDB SQL of op9: every window of every item against every window of that length.
HITS_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS k
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (
  SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q))),
h AS (SELECT doc_id, i, p.n, item_id FROM p JOIN q ON p.n = q.n AND p.k = q.k),
x AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
y AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)"""


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return extract(pages, fit_pages(pages)).select("page_id", "url", "text", "n_chars")


ENTRIES = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_language_id": (op2_language_id, None),
    "op3_quality_rules": (op3_quality_rules, None),
    "op4_quality_classifier": (op4_quality_classifier, None),
    "op5_ngram_jaccard_join": (op5_ngram_jaccard_join, SIMILAR_SQL),
    "op6_packing": (op6_packing, None),
    "op7_sharding": (op7_sharding, None),
    "op8_secret_scans": (op8_secret_scans, _sql_spans()),
    "op9_decontamination": (op9_decontamination, HITS_SQL),
    "op10_html_extraction": (op10_html_extraction, None),
    **AUDIT,
}
