"""Registered queries of the subpackage and the pipeline."""

import re
import zlib
from collections import defaultdict

import numpy as np
import oracle
import pytest
from pyspark.sql import types as T
from test_operators import brute_hits, components

import corpus_pipeline
from replyloom.llm import jaccard_join, toxicity
from replyloom.llm import secrets
from replyloom.llm.queries import ENTRIES, learn_toxicity, tokenizer_path


def test_thirteen_operators():
    assert [sum(k.startswith(f"op{n}_") for k in ENTRIES) for n in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", [k for k, (_, sql) in ENTRIES.items() if sql])
def test_against_sql(spark, data, name):
    run, sql = ENTRIES[name]
    assert oracle.differences(run(spark, data).toPandas(), oracle.connect(data).execute(sql).df()) is None


def test_pipeline(spark, data):
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = [{r[0] for r in docs.select("doc_id").collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = jaccard_join.materialize(stage(spark, docs, data), "test-stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append({r[0] for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
    assert ids[-1] == ids[-2]  # secrets are masked, their documents stay
    packed = corpus_pipeline.run(spark, data)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == ids[-1]


def test_held_out_toxicity(spark, data):
    run, _ = ENTRIES["op1_toxicity"]
    got = run(spark, data)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.where("score between 0 and 1").count() == got.count()
    assert toxicity.SAMPLE_ROWS > 0


def masked_text(text):
    """Every span of every kind replaced by a mark; overlapping spans share one."""
    spans = sorted(
        (m.start(), place, m.end()) for place, r in enumerate(secrets.BASE + secrets.ADDED)
        for m in re.finditer(r.pattern, text, re.A) if len(m[r.group]) >= r.least
    )
    out, at = "", 0
    for start, _, end in spans:
        out += text[at:start] + "<secret>" if start >= at else ""
        at = max(at, end)
    return out + text[at:]


def toxic_score(text, weights):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    _, slots = toxicity._features([words], toxicity.WordHashes())
    total = float(weights[0]) + sum(float(weights[k]) * (toxicity.PAIR_VALUE if k % 2 else 1.0) for k in set(slots.tolist()))
    return 1 / (1 + np.exp(-max(-30.0, min(30.0, total))))


def expected(spark, folder, rows, weights):
    """Rows that each stage keeps, plainly: lists of (doc_id, text) after each of the first four stages."""
    stages = [[(k, t) for k, t in rows if toxic_score(t, weights) < 0.7]]
    found = components(stages[0])
    kept = {k for k, _, least in found if k is not None and least == k}
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    return stages, kept, items


def check_packing(rows, texts):
    """Every id once, in its place, in gapless sequences of the window or less."""
    from tokenizers import Tokenizer

    coded = Tokenizer.from_file(tokenizer_path())
    own, held = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r["doc_id"], r["doc_tokens"]].append(r)
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    wanted = defaultdict(int)
    for k, t in texts:
        ids = coded.encode(t or "", add_special_tokens=False).ids + [2]
        wanted[k, len(ids)] += 1
        for r in own[k, len(ids)]:
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(piece) and r["length"] == len(piece) // 4
    for key, count in wanted.items():
        assert sum(r["length"] for r in own[key]) == count * key[1]
    assert set(own) == set(wanted)
    for places in held.values():
        ends = [0, *(o + n for o, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096


def run_stages(spark, folder, docs, weights):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    (clean,), kept, items = expected(spark, folder, rows, weights)
    got = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = jaccard_join.materialize(stage(spark, docs, folder), "test-stage")
        got.append(sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=repr))
    assert got[0] == sorted(clean, key=repr)
    # one row of each group stays: that with the least id, and whatever is linked with nothing
    assert {k for k, _ in got[1] if k is not None} == kept
    assert set(got[1]) <= set(got[0])
    hit = {k for k, n, h, _ in brute_hits(got[1], items) if k is not None and h and 20 * h >= n}
    assert got[2] == [r for r in got[1] if r[0] not in hit]
    assert got[3] == sorted(((k, t if t is None else masked_text(t)) for k, t in got[2]), key=repr)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    check_packing(pieces, got[3])
    return got


def test_stages_equal_brute_force(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    weights = learn_toxicity(docs, spark.read.parquet(f"{data}/labels.parquet"))
    got = run_stages(spark, data, docs, weights)
    assert len(got[0]) > len(got[1]) >= len(got[2]) > 0
    packed = corpus_pipeline.run(spark, data).collect()
    check_packing(packed, got[3])


def test_pipeline_of_odd_tables(spark, data):
    """Nulls in any column, empty texts, repeated rows; and no rows at all."""
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    words = " ".join(f"word{i}" for i in range(40))
    rows = [
        (1, words, "en", "a", 3), (1, words, "en", "a", 3), (2, words + " more", None, None, None), (3, None, "en", "a", 0), (4, "", None, "a", 0), (5, "   ", "de", "b", 3),
        (6, "token=abcdefgh", "en", "b", 1), (7, "İ. " * 50, "tr", "b", 1),
    ]
    frame = spark.createDataFrame(rows, schema)
    weights = np.zeros(toxicity.SLOTS, np.float32)
    docs = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = jaccard_join.materialize(stage(spark, docs, data), "test-odd")
        assert docs.columns == schema.names
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left) == {1, 3, 4, 5, 6, 7} and left[6] == "<secret>" and not weights.any()
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, data).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert docs.count() == 0


#: the columns that the contract asks for
COLUMNS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_quality_rules": {
        "doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
        "base_failed": "boolean", "kept": "boolean",
    },
    "op4_quality_classifier": {"doc_id": "bigint", "score": "double", "keep": "boolean"},
    "op6_packing": {
        "doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint",
    },
    "op7_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op10_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}
FOLDS = {"op1_toxicity": (3, 1), "op2_language_id": (4, 2)}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_folds(spark, data, name):
    got = ENTRIES[name][0](spark, data)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = got.collect()
    table = "pages" if "page_id" in kinds else "documents"
    ids = {r[0] for r in spark.read.parquet(f"{data}/{table}.parquet").select(got.columns[0]).collect()}
    assert {r[0] for r in rows} == ids
    if name in FOLDS:
        folds, out = FOLDS[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out) for r in rows)
        assert all(0 <= r["score"] <= 1 for r in rows)
    if name == "op1_toxicity":
        assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    if name == "op10_html_extraction":
        assert all(r["n_chars"] == len(r["text"]) for r in rows) and sum(bool(r["text"]) for r in rows) > len(rows) / 2
    if name == "op4_quality_classifier":
        assert all(0 <= r["score"] <= 1 and r["keep"] == (r["score"] >= 0.5) for r in rows)


def test_held_out_languages(spark, data):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in ENTRIES["op2_language_id"][0](spark, data).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held) > 0
