"""Filter audit, vector codes and URL filters against brute force."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import oracle
import pytest

from replyloom.llm import filter_audit as A
from replyloom.llm import url_filters as U
from replyloom.llm import vector_codes as V
from replyloom.llm.queries_audit import ENTRIES, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


# --- filter audit ---

def failing(rows):
    """(part, letters that fail, doc_id) of each row."""
    ids = defaultdict(list)
    for doc_id, text, _ in rows:
        if doc_id is not None:
            ids[text or ""].append(doc_id)
    for doc_id, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        bad = "A" if len(words) < 50 else ""
        bad += "B" if 100 * len(set(words)) < 65 * len(words) else ""
        bad += "C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""
        bad += "D" if re.search(r"[#$%&*|]", text) else ""
        bad += "E" if doc_id is not None and any(x < doc_id for x in ids[text]) else ""
        yield source or "", bad, doc_id


def audited(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    out = {}
    for order in map("".join, permutations("ABCDE")):
        counts = defaultdict(Counter)
        for part, bad, doc_id in failing(rows):
            gone = False
            for step, letter in enumerate(order, 1):
                c = counts[part, order, step]
                fails = letter in bad
                c["redundant"] += fails and gone
                removed = fails and not gone
                gone = gone or fails
                c["removed"] += removed
                c["kept"] += not gone
                c["unique_fails"] += bad == letter
                c["good_lost"] += removed and doc_id in good
                c["toxic_lost"] += removed and doc_id in toxic
        out |= counts
    shapley = Counter()
    for (part, order, step), c in out.items():
        shapley[part, order[step - 1]] += c["removed"]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {(p, o, s, *[c[n] for n in names], shapley[p, o[s - 1]]) for (p, o, s), c in out.items()}


def audit_rows(tmp_path, spark, rows, labels, files=1, **options):
    path = f"{tmp_path}/docs.parquet"
    for i in range(files):  # the files come in this order, so later ones may hold smaller ids
        part = spark.createDataFrame(rows[i::files], DOC).coalesce(1)
        part.selectExpr("doc_id", "text", "source", "1 AS mask", "'x' AS key", "'y' AS part").write.mode("append").parquet(path)
    got = A.filter_audit(spark, path, spark.createDataFrame(labels, LABELS), **options).collect()
    assert len(got) == len(set(map(tuple, got)))
    return set(map(tuple, got))


LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (9, LONG, "a"), (8, LONG, "b"), (8, LONG, "b"), (7, LONG, None), (None, LONG, "a"), (None, LONG, "a"), (30, "same " * 80, "a"), (31, "same " * 80, ""),
    (40, "", "a"), (41, None, "b"), (42, "UPPER case $", "b"), (3, LONG, "c"), (3, LONG, "a"), (50, LONG + " #", "a"), (51, LONG + " #", "c"), (52, LONG.upper(), "c"),
    (60, "é\u2003word\x0bnext " * 20, "c"),
]
MARKS = [(9, 1, 0), (3, 1, 1), (7, 0, 1), (8, None, None), (None, 1, 1), (30, 1, 0), (30, 0, 1), (51, 1, 0)]


@pytest.mark.parametrize("files,batches", [(1, 1), (5, 5), (5, 2)])
def test_audit_equals_brute_force(spark, tmp_path, files, batches):
    assert audit_rows(tmp_path, spark, ROWS, MARKS, files, batches=batches) == audited(ROWS, MARKS)


def test_smaller_ids_in_later_batches_retract(spark, tmp_path):
    rows = [(100 - i, LONG, f"s{i}") for i in range(6)]
    path, folder = f"{tmp_path}/docs.parquet", f"{tmp_path}/state"
    labels = spark.createDataFrame([], LABELS)
    for i, row in enumerate(rows):
        spark.createDataFrame([row], DOC).coalesce(1).write.mode("append").parquet(path)
        # the same folder goes on where the run before ended
        changes = A.audit_changes(spark, path, labels, folder=folder)
        held = {(r["part"], r["mask"]): r["n"] for r in changes.groupBy("part", "mask").sum("n").withColumnRenamed("sum(n)", "n").collect()}
        assert {k: n for k, n in held.items() if n} == {(f"s{j}", 16 if j < i else 0): 1 for j in range(i + 1)}
        assert all(held[f"s{j}", 0] == 0 for j in range(i))  # retracted
        total = {tuple(r) for r in A.audit_orders(changes).select("part", "kept").where("filter_order = 'ABCDE' and step = 5").collect()}
        assert total == {(f"s{j}", int(j == i)) for j in range(i + 1)}


def test_audit_of_an_empty_table(spark, tmp_path):
    assert audit_rows(tmp_path, spark, [], []) == set()


@pytest.mark.parametrize("disk", [0, 10**9])
def test_combining_keeps_counts(spark, tmp_path, monkeypatch, disk):
    monkeypatch.setattr(A, "COMBINE_ROWS", 3)
    monkeypatch.setattr(A, "DISK_ROWS", disk)
    assert audit_rows(tmp_path, spark, ROWS * 2, MARKS, 2) == audited(ROWS * 2, MARKS)


# --- vector codes ---

VEC = "vec_id long, embedding array<float>, label int, error string, slot int"


def coded(vectors, parts=4, entries=256, rounds=4):
    """(codes, errors, books) of rows (id, vector), plainly."""
    x = np.floor(np.array([v for _, v, *_ in vectors], np.float32).astype(float) * 1024).astype(np.int64)
    first = sorted({i: None for i, *_ in vectors if i is not None})[:entries]
    seeds = [min(i for i, (d, *_) in enumerate(vectors) if d == f) for f in first]
    cut = np.split(x, parts, axis=1)
    books = [c[seeds].copy() for c in cut]
    for r in range(rounds + 1):
        codes, errors = [], 0
        for k, c in enumerate(cut):
            d = ((c[:, None, :] - books[k][None]) ** 2).sum(-1)
            at = d.argmin(1)
            codes.append(at)
            errors = errors + d.min(1)
            if r < rounds:
                for e in set(at.tolist()):
                    books[k][e] = c[at == e].sum(0) // (at == e).sum()
    return ["".join(f"{a:02x}" for a in row) for row in zip(*codes)], errors, books


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (2, 0.01)])
def test_codes_equal_brute_force(spark, seed, spread):
    rng = np.random.default_rng(seed)
    vectors = [(int(i) * 3, np.round(rng.normal(size=8) * spread, 2).tolist(), int(i) % 3 or None, "x", 1) for i in rng.permutation(700)]
    vectors += [(i, v, n, "y", 2) for i, v, n, *_ in vectors[:40]]  # repeated rows
    frame = spark.createDataFrame(vectors, VEC).repartition(5)
    codes, errors, books = coded(vectors)
    got, found = V.compress(frame)
    assert np.array_equal(found.entries, np.stack(books))
    want = Counter((i, n, c, int(e)) for (i, _, n, *_), c, e in zip(vectors, codes, errors))
    assert Counter(map(tuple, got.collect())) == want
    by_label = Counter()
    for (_, _, n, *_), e in zip(vectors, errors):
        by_label[n] += int(e)
    rows = V.compressed_with_label_errors(frame).collect()
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows) == Counter(
        (i, c, int(e), by_label[n]) for (i, _, n, *_), c, e in zip(vectors, codes, errors)
    )


def test_pivots_prune_and_stay_exact():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (256, 4))
    x = centres[rng.integers(0, 256, 3000)] + rng.integers(-60, 60, (3000, 4))
    pivots = V._far_apart(centres, V.PIVOTS)
    index, best, made = V.nearest(x, V._distances(x, pivots), centres, V._distances(centres, pivots))
    full = ((x[:, None] - centres[None]) ** 2).sum(-1)
    assert np.array_equal(index, full.argmin(1)) and np.array_equal(best, full.min(1))
    assert made < full.size / 10
    same = np.repeat(centres[:1], 9, axis=0)  # equal entries: the lowest index
    index, _, _ = V.nearest(x, V._distances(x, pivots), same, V._distances(same, pivots))
    assert (index == 0).all()


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [
        (1, [0.5, 1.0, 0.0, 2.0], 1), (2, [nan, 0.0, 0.0, 0.0], 1), (3, [float("inf"), 0.0, 0.0, 0.0], 2), (4, None, 2), (5, [None, 1.0, 1.0, 1.0], None),
        (None, [-0.5, 1.0, 0.0, 2.0], None), (7, [-0.5, 1.0, 0.0, 2.0], None),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in V.compressed_with_label_errors(frame).collect()}
    assert set(got) == {1, None, 7} and got[7]["code"] == got[None]["code"] and all(r["error"] == 0 for r in got.values())
    assert V.compressed_with_label_errors(frame.where("vec_id in (2, 3, 4, 5)")).collect() == []
    assert V.compressed_with_label_errors(frame.where("vec_id is null")).count() == 1
    assert V.compressed_with_label_errors(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        V.compress(frame, parts=3)
    with pytest.raises(Exception, match="length"):
        V.compress(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], frame.schema))[0].collect()


# --- URL filters ---

def site_verdict(url, rules):
    """(host, path, rule, action) by the definition of the site rules."""
    host = path = ""
    if url is not None and "://" in url:
        after = url.split("://", 1)[1]
        host = re.match("[^/?#]*", after)[0]
        path = re.match("[^?#]*", after[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = []
    for action, own, start in rules:
        if (host == own or host.endswith("." + own)) and path.startswith(start):
            fit.append((len(own + start), len(own), action == "block", own + start, action))
    _, _, _, rule, action = max(fit, default=(0, 0, 0, None, None))
    return host, path, rule, action


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "https://a.NET/x", "https://xnet/", "https://Example.net/en/1?x=1", "https://www.example.net/en",
    "https://example.net/EN/", "http://example.com/de/1#t", "http://badexample.com/de/", "http://x.org/fr/", "http://org/fr/a", "http://x.org:80/fr/", "http://u@x.org/fr/",
    "http://x.org?/fr/", "ftp://a.b.net//", "http://casino-win.example.org/de/", "http://www.casino-win.example.org/de/", "http://mycasino-win.org/", "http://a.info/ads/1",
    "http://a.info/Ads/1", "http://ads-txt.info/ads/", "http://ads-x.info/", "http://é.net/ü", "x://y://z.net/", "http://a.info/?utm_campaign=spam", "http://a.info/?utm_campaign=spammer",
    "http://a.net/" + "long/" * 5000, "http://great-casino.de/",
]


def test_site_rules_equal_brute_force(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("allow", "a.net", "/long/l"), ("block", "b.net", "")]
    table = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS + URLS[:9])], "page_id int, url string, HOST string, _url int").repartition(3)
    got = U.judge_urls(table, U.rule_table(spark, [U.site_rule(*r) for r in rules]))
    assert got.columns == ["page_id", "url", "_url", "host", "path", "rule", "pattern", "verdict"]
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    assert len(found) == len(URLS) + 9
    for i, u in enumerate(URLS + URLS[:9]):
        host, path, rule, action = site_verdict(u, rules)
        assert found[i] == (host, path, rule, action or "allow"), u


def test_patterns(spark):
    found = dict(zip(URLS, (r["verdict"] for r in U.judge_urls(
        spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id int, url string"), U.rule_table(spark, url_rules())).orderBy("page_id").collect())))
    blocked = {u for u, v in found.items() if v == "block"}
    assert {"http://casino-win.example.org/de/", "http://www.casino-win.example.org/de/", "http://a.info/ads/1", "http://ads-x.info/", "http://great-casino.de/",
            "http://a.info/?utm_campaign=spam"} <= blocked
    assert not blocked & {"http://mycasino-win.org/", "http://a.info/Ads/1", "http://ads-txt.info/ads/", "http://a.info/?utm_campaign=spammer", None, "", "no scheme"}


@pytest.mark.parametrize("line,tokens", [
    ("||casino-", ("casino",)), ("casino-x/", ("x",)), ("/ads/", ("ads",)), ("/ads", ()), ("/ads|", ("ads",)), ("|a*b.c/", ("c",)), ("||x.y^", ("x", "y")), ("*", ()), ("", ()),
    ("a-bc-d", ("bc",)), ("@@||good.org/p*q/r/", ("good", "org", "r")),
])
def test_mandatory_tokens(line, tokens):
    assert U.pattern_rule(line).tokens == tokens


def test_index_loses_no_match(spark):
    """Every rule against every URL gives what the tokens fetch."""
    rng = np.random.default_rng(5)
    pieces = ["a", "ads", "x1", "net", "/", "-", ".", "?", "_", "é"]
    urls = ["http://" + "".join(rng.choice(pieces, rng.integers(1, 9))) for _ in range(300)]
    marks = ["", "*", "^", "|"]
    lines = sorted({str(rng.choice(["", "||", "|", "@@"])) + "".join(rng.choice(pieces + ["*", "^"], rng.integers(1, 5))) + str(rng.choice(marks)) for _ in range(120)})
    rules = [U.pattern_rule(x) for x in lines]
    table = spark.createDataFrame([(u,) for u in set(urls)], "url string")
    table = table.withColumn("rest", U.url_parts(table.url)["rest"]).withColumn("tokens", U.url_tokens(U.F.col("rest")))
    got = {(r["url"], r["rule"]) for r in U.matches(table, U.rule_table(spark, rules)).collect()}
    rest = {r["url"]: r["rest"] for r in table.collect()}
    want = {(u, r.rule) for u in rest for r in rules if re.search(r.regex.replace(r"\z", r"\Z"), rest[u])}
    assert got == want and len(want) > 100
    index = {r["rule"]: r for r in U.token_index(table, U.rule_table(spark, rules)).collect()}
    holds = Counter(t for r in table.collect() for t in r["tokens"])
    for r in rules:
        if r.rule in index and r.tokens:
            assert index[r.rule]["urls"] == min(holds[t] for t in r.tokens) > 0


def test_empty_table_of_urls(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id int, url string"), U.rule_table(spark, url_rules())).collect() == []


@pytest.mark.parametrize("name", list(ENTRIES))
def test_queries_against_sql(spark, data, name):
    run, sql = ENTRIES[name]
    assert oracle.differences(run(spark, data).toPandas(), oracle.connect(data).execute(sql).df()) is None
