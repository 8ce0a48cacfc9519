import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from replyloom import fixtures as X
from replyloom import runtime
from replyloom.operators import density, metric_index
from replyloom.operators import tfidf as V
from replyloom.operators.components import connected_components
from replyloom.operators.lsa import explained_variance_ratio, lsa_fit
from replyloom.operators import retrieval
from replyloom.operators.retrieval import retrieve
from replyloom.operators.topics import nmf, topic_keywords, topic_shares
from replyloom.plans import escalation as E
from replyloom.plans import systems as Y
from replyloom.registry import answers
from replyloom.streaming.route import route_files, route_stream

WORDS = ["bag", "lost", "flight", "late", "seat", "refund", "crew", "meal", "gate", "miles"]


def corpus(n, seed=5):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9)))) for i in range(n)]


def python_tfidf(texts, config):
    grams = []
    for t in texts:
        w = t.split()
        grams.append(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    total, docs = {}, {}
    for g in grams:
        for x in g:
            total[x] = total.get(x, 0) + 1
        for x in set(g):
            docs[x] = docs.get(x, 0) + 1
    n = len(texts)
    kept = [x for x in total if docs[x] >= config.min_df and docs[x] <= config.max_df * n]
    kept = sorted(kept, key=lambda x: (-total[x], x))[: config.max_features]
    out = []
    for g in grams:
        row = {x: g.count(x) * (math.log((1 + n) / (1 + docs[x])) + 1) for x in set(g) & set(kept)}
        norm = math.sqrt(sum(v * v for v in row.values())) or 1.0
        out.append({x: v / norm for x, v in row.items()})
    return out


def test_weights_against_plain_python(spark):
    rows = corpus(60)
    config = V.TfidfConfig(40, True, 2, 0.8, ())
    df = spark.createDataFrame(rows, "id int, text string")
    model = V.tfidf_fit(df, "text", config)
    want = python_tfidf([t for _, t in rows], config)
    got = [{} for _ in rows]
    for r in V.tfidf_weights(model, df, ["id"], "text").collect():
        got[r["id"]][r["term"]] = r["weight"]
    for g, w in zip(got, want):
        assert g.keys() == w.keys()
        for t in g:
            assert g[t] == pytest.approx(w[t], abs=1e-12)


@pytest.mark.parametrize("mode", ["naive", "resolution_weighted"])
def test_retrieval_against_brute_force(spark, mode):
    rng = random.Random(11)
    config = V.TfidfConfig(2500, True, 1, 1.0, ())
    kb = [(i, t, rng.choice([0.95, 0.75, 0.6, 0.4, 0.2, 0.1])) for i, t in corpus(80, 7)]
    questions = [(i, t) for i, t in corpus(12, 8)] + [(50, "unknown words"), (51, "")]
    kb_df = spark.createDataFrame(kb, "kb_id int, customer_inquiry string, resolution_score double")
    q_df = spark.createDataFrame(questions, "query_id int, text string")
    model = V.tfidf_fit(kb_df, "customer_inquiry", config)
    idf = dict(zip(model.vocabulary, model.idf))
    weights = python_tfidf([t for _, t, _ in kb], config)

    def vector(text):
        w = text.split()
        g = [x for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])] if x in idf]
        row = {x: g.count(x) * idf[x] for x in set(g)}
        norm = math.sqrt(sum(v * v for v in row.values())) or 1.0
        return {x: v / norm for x, v in row.items()}

    got = {}
    for r in retrieve(model, q_df, kb_df, 5, mode).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["kb_id"], r["composite_score"])
    assert set(got) == {q for q, _ in questions}
    for q, text in questions:
        v = vector(text)
        ranked = []
        for (i, _, res), w in zip(kb, weights):
            sim = sum(v[x] * w[x] for x in v if x in w)
            s = sim if mode == "naive" else sim * 0.2 if res <= 0.2 else sim * 0.65 + res * (1 - 0.65)
            ranked.append((-round(s, 4), i))
        ranked.sort()
        assert [got[q][k + 1] for k in range(5)] == [(i, pytest.approx(-s, abs=1.01e-4)) for s, i in ranked[:5]]


def test_retrieval_keeps_queries_off_the_driver(spark, monkeypatch):
    """Several parts, slices and blocks of queries give the rows of a single group."""
    rng = random.Random(12)
    config = V.TfidfConfig(2500, True, 1, 1.0, ())
    levels = [0.95, 0.75, 0.6, 0.4, 0.2, 0.1]
    kb = [(i, t, rng.choice(levels)) for i, t in corpus(90, 9)]
    kb += [(i + 100, t, r) for i, t, r in kb[:30]] + [(300, kb[0][1], None), (301, "", 0.6)]
    questions = corpus(25, 10) + [(50, "unknown words"), (51, kb[0][1])]
    kb_df = spark.createDataFrame(kb, "kb_id int, customer_inquiry string, resolution_score double")
    q_df = spark.createDataFrame(questions, "query_id int, text string")
    model = V.tfidf_fit(kb_df, "customer_inquiry", config)

    def fail(*_):
        raise AssertionError("rows on the driver")

    for name in ("toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(type(q_df), name, fail)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", fail)

    def hits():
        got = retrieval.compare_retrieval(model, q_df, kb_df, 4).collect()
        return sorted((r["mode"], r["query_id"], r["rank"], r["kb_id"], r["composite_score"]) for r in got)

    whole = hits()
    assert {(m, q) for m, q, *_ in whole} == {(m, q) for m in retrieval.MODES for q, _ in questions}
    for name, value in (("QUERY_BLOCK", 3), ("CELLS", 2000), ("KB_SLICE", 4), ("QUERY_PART", 7)):
        monkeypatch.setattr(retrieval, name, value)
    small = hits()
    assert [r[:3] for r in small] == [r[:3] for r in whole]
    assert [r[4] for r in small] == [pytest.approx(r[4], abs=1.01e-4) for r in whole]
    assert sum(a[3] != b[3] for a, b in zip(small, whole)) <= 1  # sums on a rounding edge may swap


def brute_clusters(points, min_size, min_samples, eps):
    ids = sorted(points)
    near = {i: [j for j in ids if math.dist(points[i], points[j]) <= eps] for i in ids}
    core = {i for i in ids if len(near[i]) >= min_samples}
    label, n = {i: -1 for i in ids}, 0
    seen = set()
    for i in ids:
        if i not in core or i in seen:
            continue
        part, todo = set(), [i]
        while todo:
            j = todo.pop()
            if j in part:
                continue
            part.add(j)
            todo.extend(k for k in near[j] if k in core)
        seen |= part
        if len(part) >= min_size:
            for j in part:
                label[j] = n
            n += 1
    return label


def test_density_clusters_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(metric_index, "PIECE", 16)  # many pieces per cell
    rng = np.random.default_rng(3)
    blobs = [c + 0.05 * rng.standard_normal((60, 4)) for c in (np.zeros(4), np.full(4, 0.6))]
    noise = rng.uniform(-2, 2, (40, 4))
    copies = np.tile(blobs[0][0], (90, 1))  # a third of all rows is the same point
    data = np.concatenate([*blobs, noise, copies])
    points = {i: tuple(float(x) for x in p) for i, p in enumerate(data)}
    df = spark.createDataFrame([(i, list(p)) for i, p in points.items()], "vec_id int, embedding array<double>")
    got = {r["vec_id"]: r["label"] for r in density.density_cluster(df, 12, 5, 0.12).collect()}
    assert got == brute_clusters(points, 12, 5, 0.12)
    assert len(set(got.values())) >= 3


def test_components(spark, monkeypatch):
    monkeypatch.setattr(runtime, "COOL_ROWS", 10)
    monkeypatch.setattr(runtime, "HOT_SHARE", 4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 400)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 400: 400, 500: 400}
    assert {r["node"]: r["component"] for r in got} == want


def planted(spark):
    rng = random.Random(9)
    groups = (["bag", "lost", "belt"], ["flight", "late", "gate"])
    rows = [(i, " ".join(rng.choice(groups[i % 2]) for _ in range(8))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string")
    model = V.tfidf_fit(df, "text", V.TfidfConfig(50, False, 1, 1.0, ()))
    return df, model, model.transform(df, "text").drop("text")


def test_topics_are_recovered(spark):
    _, tfidf, vectors = planted(spark)
    model = nmf(vectors, ["id"], len(tfidf.vocabulary), k=2, rounds=15)
    assert (model.topics >= 0).all()
    assert all(b <= a + 1e-9 for a, b in zip(model.losses, model.losses[1:]))
    words = {}
    for r in topic_keywords(model, tfidf, 3).collect():
        words.setdefault(r["topic_id"], set()).add(r["term"])
    assert sorted(map(sorted, words.values())) == [["bag", "belt", "lost"], ["flight", "gate", "late"]]
    assert sorted(r["dominant_inquiries"] for r in topic_shares(model.texts).collect()) == [30, 30]


def test_svd_rebuilds_the_vectors(spark):
    _, tfidf, vectors = planted(spark)
    width = len(tfidf.vocabulary)
    model = lsa_fit(vectors, width, width)
    s = model.singular_values
    assert all(a >= b > 0 for a, b in zip(s, s[1:]))
    x = np.zeros((60, width))
    for r in V.long_weights(vectors, ["id"]).collect():
        x[r["id"], r["position"]] = r["weight"]
    assert s == pytest.approx(np.linalg.svd(x)[1][: len(s)], abs=1e-6)
    projected = model.transform(vectors)
    u = np.zeros((60, len(s)))
    for r in projected.select("id", "lsa").collect():
        u[r["id"]] = r["lsa"]
    assert np.allclose(u @ np.array(model.components).T, x, atol=1e-6)
    ratios = explained_variance_ratio(projected, vectors).agg(F.sum("ratio")).first()[0]
    assert ratios == pytest.approx(1.0, abs=1e-6)


@pytest.fixture(scope="module")
def gold(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        y = i % 3 == 0
        text = " ".join(rng.choice(["stranded", "lost", "late"] if y else ["thanks", "seat", "late"]) for _ in range(6))
        rows.append((i, text + (" lawyer" if i % 12 == 0 else ""), int(y)))
    return spark.createDataFrame(rows, "id int, text string, y int")


def test_escalation_classifier_solves_the_weighted_problem(spark, gold):
    config = V.TfidfConfig(50, True, 1, 1.0, ())
    fitted = E.fit_escalation(gold, config=config)
    vectors = fitted.tfidf.transform(gold, "text")
    x = np.zeros((60, len(fitted.tfidf.vocabulary)))
    for r in V.long_weights(vectors, ["id"]).collect():
        x[r["id"], r["position"]] = r["weight"]
    y = np.array([r["y"] for r in gold.orderBy("id").collect()], dtype=float)
    weight = np.where(y == 1, 60 / (2 * y.sum()), 60 / (2 * (60 - y.sum())))
    a = np.hstack([x, np.ones((60, 1))])
    beta, penalty = np.zeros(a.shape[1]), np.eye(a.shape[1])
    penalty[-1, -1] = 0.0  # the intercept is free
    for _ in range(50):  # Newton steps on sum of weighted losses + half the squared norm
        p = 1 / (1 + np.exp(-a @ beta))
        gradient = a.T @ (weight * (p - y)) + penalty @ beta
        beta -= np.linalg.solve((a.T * (weight * p * (1 - p))) @ a + penalty, gradient)
    assert np.allclose(fitted.model.coefficients.toArray(), beta[:-1], atol=1e-3)


def test_calibration_and_holdout(spark, gold):
    config = V.TfidfConfig(50, True, 1, 1.0, ())
    classifier, result = E.calibrate(gold, config=config)
    row = result.first()
    assert row["roc_auc"] > 0.95 and row["cost"] <= 15 and row["guardrail_hits"] == 5
    assert row["tp"] + row["fn"] == 20 and row["fp"] + row["tn"] == 40
    held = E.calibrate(gold, config=config, holdout=0.4)[1].first()
    assert 0 < held["tp"] + held["fn"] + held["fp"] + held["tn"] < 60


def test_full_system_answers(spark, gold):
    config = V.TfidfConfig(50, True, 1, 1.0, ())
    kb = spark.createDataFrame(
        [(1, "thanks seat late", "we moved your seat", 0.95), (2, "stranded lost", "please wait", 0.4)],
        "kb_id int, customer_inquiry string, brand_reply string, resolution_score double",
    )
    retriever = V.tfidf_fit(kb, "customer_inquiry", config)
    classifier, best = E.calibrate(gold, config=config)
    queries = gold.withColumnRenamed("id", "query_id")
    answers = Y.system_full(queries, kb, retriever, classifier, best.first()["threshold"])
    rows = {r["query_id"]: r for r in answers.collect()}
    assert len(rows) == 60 and all(r["retrieved_examples_count"] == 2 for r in rows.values())
    assert rows[0]["predicted_intent"] == "TIER_0_LEGAL_AND_DOT_REGULATORY"
    assert rows[0]["confidence"] == 1.0 and "'lawyer'" in rows[0]["escalation_reason"]
    calm = [r for r in rows.values() if not r["escalate_to_human"]]
    assert calm and {r["generated_reply"] for r in calm} == {"we moved your seat"}


def test_intent_system(spark, gold):
    named = gold.withColumn("category", F.when(F.col("y") == 1, "BAGGAGE").otherwise("refund"))
    model = E.fit_intent(named, config=V.TfidfConfig(50, True, 1, 1.0, ()))
    assert model.classes == ("BAGGAGE_ISSUES", "REFUNDS_AND_COMPENSATION")
    got = Y.system_tfidf(named, model).where(
        F.col("predicted_intent") == F.when(F.col("y") == 1, "BAGGAGE_ISSUES").otherwise("REFUNDS_AND_COMPENSATION")
    )
    assert got.count() >= 55


def test_protection_cases(spark):
    cases = spark.createDataFrame(
        [("severe asthma attack", 0.994), ("my account was hacked", 0.995), ("a plain question", 0.3),
         ("a plain question", 0.9)], "query string, confidence double",
    )
    got = [(r["final_decision"], r["proof_status"]) for r in E.protection_check(cases).collect()]
    assert got == [("ESCALATED", "PROTECTED")] * 2 + [("ESCALATED", "VULNERABLE"), ("NOT_ESCALATED", "VULNERABLE")]


def test_stream_equals_batch(spark, gold, tmp_path):
    classifier = E.fit_escalation(gold, config=V.TfidfConfig(50, True, 1, 1.0, ()))
    source = str(tmp_path / "posts")
    gold.select("id", F.concat(F.lit("@someone "), "text").alias("text")).repartition(3).write.parquet(source)
    batch = route_stream(spark.read.parquet(source), classifier, 0.5)
    stream = route_stream(
        spark.readStream.schema("id int, text string").parquet(source), classifier, 0.5
    )
    target = str(tmp_path / "routed")
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        .option("path", target).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(target).select(*batch.columns).collect()))
    assert got == sorted(map(tuple, batch.collect())) and len(got) == 60
    assert all("<CUSTOMER_HANDLE>" in r[1] for r in got)


def test_files_are_routed_once(spark, tmp_path):
    """A second run routes new files only; a run that stops half way doubles no row."""
    source, folder = str(tmp_path / "posts"), str(tmp_path / "state")
    rows = [(i, f"text {i}", (i % 10) / 10) for i in range(40)]
    spark.createDataFrame(rows, "id int, text string, p double").repartition(4).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def routed(score):
        return route_files(spark, source, schema, folder, score, 0.5, files=1)

    def fails(df):
        late = F.when(F.col("id") % 10 == 7, F.raise_error(F.lit("stop"))).otherwise(F.col("p"))
        return df.withColumn("p", late.cast("double"))

    with pytest.raises(Exception, match="stop"):
        routed(fails)
    first = sorted((r["id"], r["escalate_to_human"]) for r in routed(lambda df: df).collect())
    assert first == [(i, p >= 0.5) for i, _, p in rows]
    spark.createDataFrame([(99, "more", 0.9)], "id int, text string, p double").write.mode("append").parquet(source)
    assert sorted(r["id"] for r in routed(lambda df: df).collect()) == [*range(40), 99]
    assert routed(lambda df: df).count() == 41


@pytest.mark.parametrize("least", [0.0, 0.15, 0.4, 0.9])
def test_threshold_join_equals_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(retrieval, "KB_SLICE", 9)
    monkeypatch.setattr(retrieval, "QUERY_PART", 7)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(7)

    def side(n, key):
        rows = []
        for i in range(n):
            terms = rng.choice(30, rng.integers(0, 12), replace=False)
            weights = rng.random(len(terms)) ** 3 + 1e-3
            rows += [(i, int(t), float(w)) for t, w in zip(terms, weights / max(np.linalg.norm(weights), 1e-9))]
        return rows, spark.createDataFrame(rows, f"{key} long, position int, weight double")

    q, q_df = side(20, "query_id")
    k, k_df = side(40, "kb_id")
    a, b = np.zeros((20, 30)), np.zeros((40, 30))
    for m, rows in ((a, q), (b, k)):
        for i, t, w in rows:
            m[i, t] = w
    sims = a @ b.T
    want = {(i, j): sims[i, j] for i, j in zip(*np.nonzero((sims >= max(least, 1e-12))))}
    got = {(r["query_id"], r["kb_id"]): r["similarity"] for r in retrieval.cosine_join(q_df, k_df, least).collect()}
    assert got == pytest.approx(want)


def test_fits_tell_their_distance_from_the_optimum(spark, gold):
    fitted = E.fit_escalation(gold, config=V.TfidfConfig(50, True, 1, 1.0, ()))
    assert fitted.violation < 1e-3
    _, tfidf, vectors = planted(spark)
    model = nmf(vectors, ["id"], len(tfidf.vocabulary), k=2)
    assert model.converged and model.violation < 0.1
    few = lsa_fit(vectors, len(tfidf.vocabulary), 2, oversample=1)
    whole = lsa_fit(vectors, len(tfidf.vocabulary), len(tfidf.vocabulary))
    assert few.converged and whole.converged
    for got, true, room in zip(few.singular_values, whole.singular_values, few.residuals):
        assert abs(got**2 - true**2) <= room + 1e-9


@pytest.mark.parametrize("mode", retrieval.MODES)
def test_retrieval_by_blocks_equals_all_pairs_without_a_shuffle(spark, monkeypatch, mode):
    monkeypatch.setattr(retrieval, "KB_SLICE", 7)
    monkeypatch.setattr(retrieval, "QUERY_PART", 5)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    met = []
    meet = retrieval.met_blocks
    monkeypatch.setattr(retrieval, "met_blocks", lambda *a: met.append(meet(*a)) or met[-1])
    rng = np.random.default_rng(3)
    levels = (0.95, 0.75, 0.6, 0.2, 0.1, None)

    def texts(n):
        return [" ".join(f"w{t}" for t in rng.integers(0, 20, rng.integers(0, 8))) for _ in range(n)]

    known = [(i, t, levels[i % 6]) for i, t in enumerate(texts(50) + ["w1 w2 w3"] * 12)]
    asked = list(enumerate(texts(20) + ["w1 w2 w3", "unknown"]))
    kb = spark.createDataFrame(known, "kb_id long, customer_inquiry string, resolution_score double")
    model = V.tfidf_fit(kb, "customer_inquiry", V.TfidfConfig(300, True, 1, 1.0, ()))

    def vectors(df, text, key):
        return {r[key]: r["vector"].toArray() for r in model.transform(df, text).collect()}

    q_df = spark.createDataFrame(asked, "query_id long, text string")
    a, b = vectors(q_df, "text", "query_id"), vectors(kb, "customer_inquiry", "kb_id")
    got = {}
    for r in retrieval.retrieve(model, q_df, kb, 3, mode).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["kb_id"], r["composite_score"]))
    assert len(got) == len(asked)
    for i, rows in got.items():
        scored = []
        for j, _, resolution in known:
            sim = float(a[i] @ b[j])
            if mode != "naive":
                sim = -1.0 if resolution is None else sim * 0.2 if resolution <= 0.2 else sim * 0.65 + resolution * 0.35
            scored.append((-math.floor(sim * 1e4 + 0.5) / 1e4, j))
        want = [(n, j, pytest.approx(-s, abs=1.01e-4)) for n, (s, j) in enumerate(sorted(scored)[:3], 1)]
        assert sorted(rows) == want
    plan = met[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Sort" not in plan


def test_cosine_join_query_returns_every_pair_that_shares_a_term(spark, data):
    from replyloom.registry.vectors import ENTRIES

    run, sql = ENTRIES["cosine_join"]
    assert "sim >=" not in sql
    assert run(spark, data).where("similarity < 0.1").count() > 0


@pytest.mark.parametrize("bigrams", [False, True])
def test_terms_are_counted_as_numbers(spark, bigrams):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{t}" for t in rng.integers(0, 9, n)) for n in (0, 1, 2, 30, 200)] * 3
    df = spark.createDataFrame([(t,) for t in [*texts, None, "w1 w1 w1"]], "text string").coalesce(1)
    corpus, docs = Counter(), Counter()
    for t in [*texts, "w1 w1 w1"]:
        words = t.split()
        grams = words + ([f"{a} {b}" for a, b in zip(words, words[1:])] if bigrams else [])
        corpus.update(grams)
        docs.update(set(grams))
    config = V.TfidfConfig(10, bigrams, 1, 1.0, ())
    got = V.term_statistics(df, "text", config)
    assert {r["term"]: (r["corpus_count"], r["doc_count"]) for r in got.collect()} == {t: (n, docs[t]) for t, n in corpus.items()}
    # one row for a term of a batch, not one for every occurrence
    counted = [*V._counted(pa.array([t.split() for t in texts]), bigrams)]
    assert sum(b.num_rows for b in counted) == len(corpus)


ODD_TEXTS = [
    None, "", " ", "a b c", "...", "the", "Ünï_çödé ünï_çödé 12 x 3", "w1 the w2 a w3, W1-w2\n\nw3", "w1 w2", "w1. w2!", "ß SS ÀB àb", "w1",
    "\u0661\u0662 w1 \U0001d7d8\U0001d7d9 w2", "I\u0307stanbul w1", "x" * 300 + " w2",
]


def _plain_vectors(texts, config):
    """Vocabulary and vectors by brute force; words are taken by Spark's own expression."""
    stop = set(config.stop_words)
    grams = []
    for words in texts:
        kept = [w for w in words if w not in stop]
        grams.append(Counter(kept + ([f"{a} {b}" for a, b in zip(kept, kept[1:])] if config.use_bigrams else [])))
    corpus, docs = sum(grams, Counter()), Counter(t for g in grams for t in g)
    n = len(texts)
    known = [t for t in corpus if config.min_df <= docs[t] and (config.max_df >= 1 or docs[t] <= config.max_df * n)]
    known = sorted(sorted(known, key=lambda t: (-corpus[t], t.encode()))[: config.max_features])
    idf = [math.log((1 + n) / (1 + docs[t])) + 1 for t in known]
    raw = [np.array([g[t] * w for t, w in zip(known, idf)]) for g in grams]
    return known, idf, [x / np.linalg.norm(x) if x.any() else x for x in raw]


@pytest.mark.parametrize("most", [6, 500])
@pytest.mark.parametrize("config", [V.TfidfConfig(0, True, 1, 1.0, ("the",)), V.TfidfConfig(0, True, 2, 0.6, ()), V.TfidfConfig(0, False, 1, 0.5, ("w2",))])
def test_vocabulary_and_vectors_equal_plain_counting(spark, monkeypatch, config, most):
    config = V.replace(config, max_features=most)
    rng = np.random.default_rng(8)
    texts = ODD_TEXTS + [" ".join(f"w{t}" for t in rng.zipf(1.5, n) % 40) for n in (1, 2, 30, 80, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    words = {r["id"]: r["w"] for r in df.select("id", V.terms(F.coalesce("text", F.lit(""))).alias("w")).collect()}
    known, idf, want = _plain_vectors([words[i] for i in range(len(texts))], config)
    monkeypatch.setattr(V, "TEXTS", 4)
    # no term goes through as a text of two words before the vocabulary is known
    counted = []
    monkeypatch.setattr(V, "term_statistics", lambda *a: counted.append(a))
    model = V.tfidf_fit(df, "text", config)
    assert not counted
    assert list(model.vocabulary) == known and model.idf == pytest.approx(idf)
    got = {r["id"]: r["vector"].toArray() for r in model.transform(df, "text").collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(want):
        assert got[i] == pytest.approx(x, abs=1e-12)


def test_words_beyond_the_limit_are_counted_as_text(spark, monkeypatch):
    df = spark.createDataFrame([("w1 w2 w3 w1 w2",), ("w2 w3",)], "text string")
    config = V.TfidfConfig(50, True, 1, 1.0, ())
    want = V.tfidf_fit(df, "text", config)
    monkeypatch.setattr(V, "PAIR_WORDS", 2)
    assert V.tfidf_fit(df, "text", config) == want


def test_projection_in_chunks_and_without_a_vector(spark, monkeypatch):
    from pyspark.ml.linalg import SparseVector, VectorUDT
    from pyspark.sql import types as T
    from replyloom.operators import lsa

    monkeypatch.setattr(lsa, "CHUNK_TERMS", 3)
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("vector", VectorUDT())])
    rows = [(0, SparseVector(3, {0: 1.0, 2: 2.0})), (1, SparseVector(3, {})), (2, None), (3, SparseVector(3, {0: 1.0, 1: 1.0, 2: 1.0})), (4, SparseVector(3, {1: 3.0}))]
    model = lsa.LsaModel(((1.0, 0.0), (0.0, 1.0), (2.0, 3.0)), (2.0, 1.0))
    projected = model.transform(spark.createDataFrame(rows, schema).coalesce(1))
    assert "zip_with" not in projected._jdf.queryExecution().toString()
    got = {r["id"]: r["lsa"] for r in projected.collect()}
    assert got == {0: [5.0, 6.0], 1: [0.0, 0.0], 2: None, 3: [3.0, 4.0], 4: [0.0, 3.0]}


def test_gram_product_in_dense_blocks(spark, monkeypatch):
    from replyloom.operators import lsa

    monkeypatch.setattr(lsa, "BLOCK_ROWS", 3)
    monkeypatch.setattr(lsa, "CHUNK_TERMS", 7)
    rng = np.random.default_rng(4)
    rows = [(rng.integers(0, 12, n).tolist(), rng.random(n).tolist()) for n in (0, 1, 2, 9, 0, 3, 12, 1, 0, 5)]  # positions repeat
    x = np.zeros((len(rows), 12))
    for i, (positions, weights) in enumerate(rows):
        np.add.at(x[i], positions, weights)
    q = rng.standard_normal((12, 4))
    df = spark.createDataFrame(rows, "indices array<int>, values array<double>").coalesce(2)
    assert np.allclose(lsa._gram_product(df, q), x.T @ (x @ q))


def test_micro_batches_of_the_routed_documents_fill_the_cores(spark, data, monkeypatch):
    seen = []

    def record(s, source, schema, folder, classifier, tau, files=None, **options):
        seen.append((len(spark.read.schema(schema).parquet(source).inputFiles()), files))
        return route_files(s, source, schema, folder, classifier, tau, files, **options)

    monkeypatch.setattr(answers, "route_files", record)
    routed = answers.ENTRIES["route_stream"][0](spark, data)
    cores = spark.sparkContext.defaultParallelism
    assert seen[0][1] >= cores and seen[0][0] >= 2 * cores
    assert routed.count() == X.gold(spark, data).count()


def test_retrieval_multiplies_few_pairs_of_unlike_rows(monkeypatch):
    """Rows of several vocabularies: blocks are compared term by term, queries without hope are left out, and nothing is lost."""
    rng = np.random.default_rng(5)

    def rows(n, key, first):
        group = np.sort(rng.integers(0, 4, n))
        listed = [np.sort(rng.choice(np.arange(30) + 30 * g, 12, replace=False)) for g in group]
        for at in listed[::9]:  # a term that is rare elsewhere
            at[0 if at[0] < 90 else -1] = 0 if at[0] < 90 else 119
        listed = [np.unique(at) for at in listed]
        weights = [w / np.linalg.norm(w) for w in (rng.random(len(at)) + 0.1 for at in listed)]
        table = pa.table({
            key: np.arange(first, first + n), "_positions": pa.array(listed, pa.list_(pa.int32())), "_weights": pa.array(weights, pa.list_(pa.float64())),
            "_cluster": group.astype(np.int32),
        })
        dense = np.zeros((n, 120))
        for i, (at, w) in enumerate(zip(listed, weights)):
            dense[i, at] = w
        return table, dense

    asking, a = rows(300, "query_id", 0)
    known, b = rows(400, "kb_id", 1000)
    levels = rng.choice([0.95, 0.75, 0.6, 0.4, 0.2], 400)
    known = known.append_column("resolution_score", pa.array(levels))
    works, multiplied, products = [], [], retrieval._products

    class Found:
        def withColumn(self, *_):
            return self

    def counted(x, y, width):
        multiplied.append((len(x[0]) - 1) * (len(y[0]) - 1))
        out = products(x, y, width)
        np.testing.assert_allclose(out, retrieval._dense(x, np.arange(width), width) @ retrieval._dense(y, np.arange(width), width).T, atol=1e-6)
        return out

    monkeypatch.setattr(retrieval, "met_blocks", lambda held, sent, work, *_: works.append(work) or Found())
    monkeypatch.setattr(retrieval, "F", type("Names", (), {"col": staticmethod(lambda _: type("C", (), {"cast": lambda *_: None})())}))
    monkeypatch.setattr(retrieval, "_products", counted)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 100)
    monkeypatch.setattr(retrieval, "CELLS", 12000)
    monkeypatch.setattr(retrieval, "COLUMN", 8)
    floor = {"resolution_weighted": 0.35 * 0.95}
    retrieval._matches(None, None, {"query_id": "bigint", "kb_id": "bigint"}, 120, 2, ("resolution_weighted",), 0.65, floor)
    blocks = [known.slice(200, 200), known.slice(0, 200)]
    got = {}
    for batch in works[0](iter(blocks), asking):
        for r in batch.to_pylist():
            got.setdefault(r["query_id"], set()).add(r["kb_id"])
    sims = a @ b.T
    scores = np.where(levels <= 0.2, sims * 0.2, sims * 0.65 + levels * 0.35)
    for i in range(300):
        best = np.argsort(-scores[i], kind="stable")[:2]
        assert {1000 + int(j) for j in best if scores[i, j] >= floor["resolution_weighted"] + 1e-3} <= got[i]
    assert sum(multiplied) < 0.6 * 300 * 400


def test_retrieval_by_clusters_gives_the_same_hits(spark, monkeypatch):
    rng = random.Random(3)
    kb = [(i, t, rng.choice([0.95, 0.75, 0.4, None])) for i, t in corpus(80, 4)] + [(200 + i, "", 0.6) for i in range(3)]
    kb_df = spark.createDataFrame(kb, "kb_id int, customer_inquiry string, resolution_score double")
    q_df = spark.createDataFrame(corpus(20, 8) + [(50, "unknown words"), (51, kb[0][1])], "query_id int, text string")
    model = V.tfidf_fit(kb_df, "customer_inquiry", V.TfidfConfig(2500, True, 1, 1.0, ()))

    def hits():
        got = retrieval.compare_retrieval(model, q_df, kb_df, 3).collect()
        return sorted((r["mode"], r["query_id"], r["rank"], r["composite_score"]) for r in got)

    whole, clustered = hits(), []
    near = retrieval._clustered
    for name, value in (("CLUSTERED", 0), ("CLUSTERS", 4), ("KB_SLICE", 9), ("QUERY_PART", 6)):
        monkeypatch.setattr(retrieval, name, value)
    monkeypatch.setattr(retrieval, "_clustered", lambda *a: clustered.append(near(*a)) or clustered[-1])
    assert hits() == [(*r[:3], pytest.approx(r[3], abs=1.01e-4)) for r in whole]
    assert len(clustered) == 2
