import random

import pytest
from pyspark.sql import functions as F

from replyloom import runtime
from replyloom.functions import judge as J
from replyloom.operators import curves as C
from replyloom.operators import gold as G
from replyloom.operators import metrics as M
from replyloom.plans import systems as Y

# Ratings (person, rubric) and label pairs (first, second) of the published studies.
RATINGS = [(2.95, 4.86), (3.2, 3.5), (3.7, 4.6), (3.75, 4.06), (3.75, 3.5), (3.7, 3.75), (2.8, 3.75),
           (3.85, 3.75), (4.2, 3.5), (4.45, 4.06), (3.5, 4.86), (2.85, 3.75), (2.5, 3.5), (1.8, 4.6),
           (2.15, 4.29)]
RELABELS = [(0, 0)] * 2 + [(0, 1)] * 16 + [(1, 1)] * 13 + [(1, 0)]


def test_kappa_of_rating_tiers(spark):
    df = spark.createDataFrame(
        RATINGS, "human_overall_score double, machine_overall_score double"
    ).withColumn(
        "delta_score", J.delta_score(F.col("human_overall_score"), F.col("machine_overall_score"))
    )
    got = M.agreement_study(df).first()
    assert got["total_cases"] == 15 and got["large_disagreements"] == 3
    assert got["cohens_kappa"] == pytest.approx(-0.0150376, abs=1e-6)
    assert got["interpretation"] == "Fair / Weak Agreement"


def test_kappa_of_relabels(spark):
    df = spark.createDataFrame(
        [(i, a, b, a == b) for i, (a, b) in enumerate(RELABELS)],
        "id int, original_escalate int, blind_relabel_escalate int, is_consistent boolean",
    )
    got = M.relabel_audit(df, df).first()
    assert got["agreement"] == 0.46875 and got["drift_cases"] == 17
    assert got["kappa"] == pytest.approx(0.0354610, abs=1e-6)
    assert got["drift_examples"] == "2,3,4"


def test_kappa_without_variation(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert M.cohen_kappa(df, "a", "b").first()["kappa"] is None
    ids = df.select(F.lit(1).alias("id"), F.col("a").alias("original_escalate"),
                    F.col("b").alias("blind_relabel_escalate"), F.lit(True).alias("is_consistent"))
    assert M.relabel_audit(ids, ids).first()["kappa"] == 1.0


def test_binary_metrics_of_the_keyword_system(spark):
    rows = [(1, 1)] * 2 + [(1, 0)] * 78 + [(0, 0)] * 80
    got = M.binary_metrics(spark.createDataFrame(rows, "y int, pred int")).first()
    assert (got["fn"], got["fp"], got["cost"]) == (78, 0, 1170.0)
    assert round(got["recall"], 4) == 0.025 and round(got["f1"], 4) == 0.0488
    nothing = M.binary_metrics(spark.createDataFrame([(1, 0)], "y int, pred int")).first()
    assert nothing["precision"] == 0.0 and nothing["f1"] == 0.0


def scored(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(rng.random() < 0.3,) for _ in range(n)]
    data = [(int(y), round(min(1.0, max(0.0, rng.gauss(0.6 if y else 0.4, 0.2))), 2)) for (y,) in rows]
    return data, spark.createDataFrame(data, "y int, p double")


def test_cost_curve_against_brute_force(spark):
    data, df = scored(spark)
    curve = {r["i"]: r for r in C.cost_curve(df).collect()}
    assert len(curve) == 91
    best = None
    for i in range(91):
        tau = round(0.05 + i * 0.01, 2)
        fn = sum(1 for y, p in data if y and p < tau)
        fp = sum(1 for y, p in data if not y and p >= tau)
        r = curve[i]
        assert (r["threshold"], r["fn"], r["fp"], r["cost"]) == (tau, fn, fp, 15.0 * fn + fp)
        if best is None or r["cost"] < best[0]:
            best = (r["cost"], tau)
    chosen = C.best_threshold(C.cost_curve(df)).first()
    assert (chosen["cost"], chosen["threshold"]) == best
    assert [r["i"] for r in C.sample_curve(C.cost_curve(df)).orderBy("i").collect()] == list(range(0, 91, 10))


def test_dearer_misses_never_raise_the_threshold(spark):
    _, df = scored(spark)
    taus = [C.best_threshold(C.cost_curve(df, c_fn=c)).first()["threshold"] for c in (1.0, 5.0, 40.0)]
    assert taus == sorted(taus, reverse=True)


def test_areas_against_brute_force(spark):
    data, df = scored(spark)
    pos = [p for y, p in data if y]
    neg = [p for y, p in data if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert C.roc_auc(df).first()[0] == pytest.approx(wins / len(pos) / len(neg), abs=1e-9)
    points = [(0.0, 1.0)]
    for s in sorted({p for _, p in data}, reverse=True):
        tp, fp = sum(p >= s for p in pos), sum(p >= s for p in neg)
        points.append((tp / len(pos), tp / (tp + fp)))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert C.pr_auc(df).first()[0] == pytest.approx(area, abs=1e-9)
    assert C.pr_auc(df.repartition(1)).first()[0] == pytest.approx(area, abs=1e-9)


def test_position_inconsistency(spark):
    rows = [(int(i < 14), int(i < 13)) for i in range(20)]
    got = M.position_inconsistency(spark.createDataFrame(rows, "a_first_win int, b_first_win int"))
    assert got.first()["inconsistency"] == pytest.approx(0.35)


def test_judge_gap_grows_with_length(spark):
    base = "<CUSTOMER_HANDLE> Please see the Fly Delta app. "
    df = spark.createDataFrame([("a flight", base, base + "word " * 70)],
                               "query string, left_reply string, right_reply string")
    got = M.judge_gap(df).first()
    assert got["unmitigated_gap"] == 0.0 and got["mitigated_gap"] < 0


def test_grounding(spark):
    df = spark.createDataFrame(
        [(0.75, False, 0, False), (0.6, True, 1, False), (None, True, 0, True), (0.6, False, 1, False)],
        "r double, e boolean, y int, s boolean",
    )
    got = [r[0] for r in df.select(M.grounding(*[F.col(c) for c in "reys"])).collect()]
    assert got == [1.0, 1.0, 0.20, 0.50]


def test_quota_counts_existing_rows(spark):
    cands = spark.createDataFrame([(i, i % 4 == 0) for i in range(80)], "thread_id int, e boolean")
    cands = cands.select("thread_id", F.col("e").cast("int").alias("ground_truth_escalate"))
    existing = spark.createDataFrame([(900 + i, 1) for i in range(7)], "thread_id int, ground_truth_escalate int")
    got = G.quota_sample(cands, existing, 20).groupBy("ground_truth_escalate").count().collect()
    assert {r[0]: r[1] for r in got} == {1: 3, 0: 10}


def test_large_limits_are_ranked_in_slices(spark, monkeypatch):
    df = spark.range(0, 900).select("id", (F.col("id") % 10 == 0).alias("g"))
    plain = {tuple(r) for r in G.first_n_per(df, ["g"], ["id"], 200).collect()}
    monkeypatch.setattr(runtime, "GROUP_LIMIT", 10)
    sliced = {tuple(r) for r in G.first_n_per(df, ["g"], ["id"], 200).collect()}
    assert plain == sliced and len(plain) == 290


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(0, 500)
    one = [r[0] for r in G.hash_sample(df.repartition(1), "id", 42, 50).collect()]
    many = [r[0] for r in G.hash_sample(df.repartition(7), "id", 42, 50).collect()]
    assert one == many and len(set(one)) == 50
    assert one != [r[0] for r in G.hash_sample(df, "id", 123, 50).collect()]


def test_audit_slice_bounds(spark):
    for n, expected in ((160, 32), (4, 3), (2, 2), (11, 3)):
        assert G.audit_slice(spark.range(0, n)).count() == expected


def test_renumber_is_consecutive(spark):
    got = G.renumber(spark.range(0, 1203).repartition(5), ["id"]).collect()
    assert {r["id"] for r in got} == {f"GOLD_{i:03d}" for i in range(1, 1204)}


def test_label_validation(spark):
    df = spark.createDataFrame([("4.5", 3.0), ("good", 5.5), ("good", 1.0), (None, None)],
                               "human_rationale string, tone double")
    got = [(r["valid"], r["problem"]) for r in G.validate_labels(df, ratings=["tone"]).collect()]
    assert got == [
        (False, "human_rationale looks like a number"), (False, "tone out of range"), (True, None),
        (False, "tone out of range"),
    ]


def test_constant_system_never_escalates(spark):
    q = spark.createDataFrame([(1, "sue you", 1), (2, "hi", 0)], "query_id int, text string, y int")
    got = {r["system"]: r for r in Y.benchmark([Y.system_constant(q), Y.system_keyword(q)]).collect()}
    constant = [r for s, r in got.items() if "Canned" in s][0]
    keyword = [r for s, r in got.items() if "Canned" not in s][0]
    assert (constant["fn"], constant["cost"], constant["mean_grounding_fidelity"]) == (1, 15.0, 0.2)
    assert (keyword["tp"], keyword["fn"], keyword["mean_grounding_fidelity"]) == (1, 0, 0.75)


def test_label_candidates_skip_labelled_rows_first(spark):
    said = "one two three four five six seven"
    threads = spark.createDataFrame(
        [(f"t{i}", i, said, said, 2) for i in range(600)],
        "thread_id string, leaf_tweet_id long, customer_inquiry_text string, "
        "initial_brand_reply string, num_turns int",
    )
    order = [r[0] for r in G.hash_sample(threads, "thread_id", 42, 600).collect()]
    labels = spark.createDataFrame([(t,) for t in order[:500]], "thread_id string")
    got = G.label_candidates(threads, labels, 500)
    assert {r[0] for r in got.collect()} == set(order[500:])


def test_ties_of_one_root_do_not_depend_on_partitioning(spark):
    said = "one two three four five six seven"
    threads = spark.createDataFrame(
        [("t", i, said, said, 2) for i in range(50)],
        "thread_id string, leaf_tweet_id long, customer_inquiry_text string, "
        "initial_brand_reply string, num_turns int",
    )
    none = spark.createDataFrame([], "thread_id string")
    kept = [
        sorted(G.hash_sample(threads.repartition(p), "thread_id", 42, 7, ["leaf_tweet_id"]).collect())
        for p in (1, 7)
    ]
    assert kept[0] == kept[1]
    assert G.label_candidates(threads, none, 7).count() == 7


def test_last_correction_counts(spark):
    gold = spark.createDataFrame(
        [("a", 0, "X", "n"), ("b", 1, "Y", "m")],
        "id string, ground_truth_escalate int, ground_truth_intent string, human_rationale string",
    )
    fixes = spark.createDataFrame(
        [("a", 1, "P", "first", "2024-01-01"), ("a", 0, "Q", "second", "2024-02-01")],
        "id string, ground_truth_escalate int, ground_truth_intent string, human_rationale string, "
        "corrected_at string",
    )
    got = {r["id"]: r for r in G.apply_corrections(gold, fixes.repartition(2)).collect()}
    assert len(got) == 2 and got["a"]["ground_truth_intent"] == "Q" and got["b"]["ground_truth_intent"] == "Y"
