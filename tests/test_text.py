import random

import pytest
from pyspark.sql import functions as F

from replyloom.functions import judge as J
from replyloom.functions import rules as R
from replyloom.functions.privacy import MaskRules, pii_counts, scrub
from replyloom.functions.text import (
    bigrams, is_bare_numeric, latin_words, parse_post_time, profile_signatures, split_signature,
    terms, word_count,
)
from replyloom.operators.profile import distinct_n


def column(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def x():
    return F.col("x")


def test_masking_steps(spark):
    rows = {
        "mail me at jo.b@mail.example.com now": "mail me at <EMAIL_ADDRESS> now",
        "call 0061234567890": "call <PHONE_NUMBER>",
        "card 4111 1111 1111 1111 ok": "card <CARD_NUMBER> ok",
        "4111111111111111": "411<PHONE_NUMBER>",
        "my confirmation: AB12CD please": "my <PNR_CONFIRMATION_CODE> please",
        "on flight 123 and DL 45": "on <FLIGHT_NUM:DL123> and <FLIGHT_NUM:DL45>",
        "@Delta hi @bob @deltaX @DELTA": "@Delta hi <CUSTOMER_HANDLE> <CUSTOMER_HANDLE> @Delta",
        "see https://www.delta.com/a  and https://t.co/xyz\nor http://foo.org/b":
            "see <DELTA_OFFICIAL_URL> and <SHORT_LINK> or <EXTERNAL_URL>",
    }
    got = column(spark, list(rows), scrub(x()))
    assert [g[0] for g in got] == list(rows.values())


def test_masking_twice_changes_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text")
    once = docs.withColumn("a", scrub(F.col("text")))
    assert once.where(F.col("a") != scrub(F.col("a"))).count() == 0
    raw_mail = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,7}\b"
    assert once.where(F.col("a").rlike(raw_mail)).count() == 0


def test_masked_counts_leave_out_the_brand_and_absent_kinds(spark):
    got = column(
        spark, ["@Delta @a @b http://x.org", "nothing"], pii_counts(x(), MaskRules(brand="delta"))
    )
    assert got == [({"urls": 1, "handles": 2},), ({},)]


def test_words(spark):
    got = column(spark, ["  a b\tc\n", "", None], word_count(x()))
    assert [g[0] for g in got] == [3, 0, 0]
    got = column(spark, ["The café x big_dog DOG2 Ice cream"], latin_words(x()), terms(x()))
    assert got[0][0] == ["the", "ice", "cream"]
    assert got[0][1] == ["the", "café", "big_dog", "dog2", "ice", "cream"]
    pairs = column(spark, ["a1 b1 c1", "a1", ""], bigrams(terms(x())))
    assert [p[0] for p in pairs] == [["a1 b1", "b1 c1"], [], []]


def test_signatures(spark):
    cut = split_signature(x())
    got = column(
        spark, ["We can help. *AB", "Sure ^xy  ", "no sign", "ends -Jo", "a *TOOLONG"],
        cut["signature"], cut["rest"],
    )
    assert got == [
        ("*AB", "We can help."), ("^xy", "Sure"), (None, "no sign"), ("-Jo", "ends"),
        (None, "a *TOOLONG"),
    ]
    found = column(spark, ["hi ^AB and /cd or *EF"], profile_signatures(x()))
    assert found[0][0] == ["^AB", "/cd"]


def test_post_times(spark):
    got = column(
        spark, ["Wed Oct 11 06:55:44 +0000 2017", "yesterday", None],
        F.date_format(parse_post_time(x()), "yyyy-MM-dd HH:mm:ss"),
    )
    assert [g[0] for g in got] == ["2017-10-11 06:55:44", None, None]


@pytest.mark.parametrize(
    "text, expected",
    [("2", True), (" 4.5 ", True), ("1e5", True), ("+,-", True), ("", False), ("12 ok", False),
     ("1,2,3", False), ("1.2", True), ("nan", True), ("good", False), ("3 4", True)],
)
def test_bare_numeric(spark, text, expected):
    assert column(spark, [text], is_bare_numeric(x())) == [(expected,)]


def test_canned_replies(spark):
    long = "Please DM us " + "word " * 30
    rows = [
        "Please send us your code", long, "We appreciate your patience", "word " * 20
        + "we appreciate your patience", "We moved your seat",
    ]
    kinds = [k[0] for k in column(spark, rows, R.canned_type(x()))]
    assert kinds == [
        "pure_dm_deflection", "partial_dm_deflection", "generic_acknowledgment",
        "substantive_contextual", "substantive_contextual",
    ]


GUARDED = [
    ("severe asthma attack, need paramedics", "CRITICAL_SAFETY_AND_MEDICAL", "asthma"),
    ("breached 14 CFR Part 259. Filing lawsuit", "LEGAL_AND_DOT_REGULATORY", "14 CFR"),
    ("bent my motorized wheelchair", "ADA_AND_MOBILITY_CRITICAL", "motorized wheelchair"),
    ("my 12 year old is alone", "VULNERABLE_PASSENGER_URGENCY", "12 year old"),
    ("account hacked!", "SECURITY_AND_ACCOUNT_TAKEOVER", "hacked"),
    ("unhacked seats", None, None),
]


def test_guardrail(spark):
    g = R.guardrail(x())
    got = column(spark, [r[0] for r in GUARDED], g["category"], g["phrase"])
    assert got == [(c, p) for _, c, p in GUARDED]


def test_severity_tiers(spark):
    names = ["High", "CRITICAL_EMERGENCY", "LEGAL_ESCALATION", "SECURITY_ESCALATION", "Low"]
    got = [g[0] for g in column(spark, names, R.severity_tier(x()))]
    assert [g.startswith("TIER_0") for g in got] == [False, True, True, True, False]


def test_gold_rules_match_substrings(spark):
    v = R.classify_inquiry(x())
    got = column(
        spark,
        ["flying to Canada", "my flight is cancelled", "Thanks a lot", "Is there wifi?",
         "this is the worst?", "nothing to see"],
        v["escalate"], v["intent"], v["rationale"],
    )
    assert [(e, i) for e, i, _ in got] == [
        (1, "TIER0_CRITICAL_EMERGENCY"), (1, "FLIGHT_DISRUPTIONS"), (0, "GENERAL_INQUIRY"),
        (0, "GENERAL_INQUIRY"), (1, "GENERAL_INQUIRY"), (1, "GENERAL_INQUIRY"),
    ]
    assert "(ada)" in got[0][2]


def test_router_classes_and_templates(spark):
    r = R.keyword_router(x())
    got = column(spark, ["delay and bag", "my luggage", "please sue", "a fee", "hi"],
                 r["intent"], r["escalate"])
    assert got == [
        ("Flight Interruption / Delay", False), ("Baggage Concern", False),
        ("Urgent Customer Complaint", True), ("Billing & Refunds", False),
        ("General Inquiries", False),
    ]
    classes = column(spark, ["tier0_emergency", "BAGGAGE_AND_CARGO", None, "", "loyalty"],
                     R.coarse_class(x()))
    assert [c[0] for c in classes] == [
        "FLIGHT_DISRUPTION", "BAGGAGE_ISSUES", "GENERAL_INQUIRY", "GENERAL_INQUIRY",
        "SKYMILES_AND_LOYALTY",
    ]
    replies = column(spark, ["BAGGAGE_ISSUES", "OTHER"], R.template_reply(x()))
    assert "baggage" in replies[0][0] and "delta.com" in replies[1][0]


def test_intent_tags_are_multi_label(spark):
    got = column(spark, ["lost bag, want a refund", "hello"], R.tag_intents(x()))
    assert got == [(["BAGGAGE_ISSUES", "REFUNDS_AND_COMPENSATION"],), ([],)]


CONCISE = ("<CUSTOMER_HANDLE> You can change your flight on delta.com or via the Fly Delta app "
           "under 'My Trips'. *CS")
WRONG = ("<CUSTOMER_HANDLE> All tickets are 100% refundable in cash upon request. Simply visit "
         "delta.com/cash-refund for instant payment. *CS")
HEDGED = ("<CUSTOMER_HANDLE> Basic tickets are generally non-refundable. Please check if your flight "
          "qualifies at <DELTA_OFFICIAL_URL>. *CS")


def test_rubric(spark):
    verbose = CONCISE.replace("Fly Delta app", "Delta application") + " word" * 60
    j = J.judge(F.lit("Can I change my flight?"), x())
    got = column(spark, [CONCISE, WRONG, HEDGED, verbose], j["overall_score"], j["word_count"])
    assert [g[0] for g in got[:3]] == [4.6, 4.04, 4.6]
    words = got[3][1]
    assert got[3][0] == pytest.approx(4.04 - 0.01 * (words - 60), abs=1e-9)
    urgent = J.judge(F.lit("asthma attack"), x())
    got = column(spark, ["ok", "our specialist will call"], urgent["safety_compliance"])
    assert [g[0] for g in got] == [1.0, 5.0]


def test_bands(spark):
    df = spark.createDataFrame([(2.99,), (3.0,), (4.29,), (4.3,)], "s double")
    assert [r[0] for r in df.select(J.score_tier(F.col("s"))).collect()] == [
        "POOR", "SATISFACTORY", "SATISFACTORY", "EXCELLENT",
    ]
    df = spark.createDataFrame([(0.8,), (0.6,), (0.4,), (0.1,)], "k double")
    assert [r[0].split()[0] for r in df.select(J.kappa_band(F.col("k"))).collect()] == [
        "Near-Perfect", "Substantial", "Moderate", "Fair",
    ]


def test_thread_without_brand_turn_has_no_reply(spark):
    from replyloom.operators.resolution import resolve_turns

    turns = spark.createDataFrame(
        [(1, 0, "customer", "hello", False), (2, 0, "customer", "hi", False), (2, 1, "brand", "x", True)],
        "conv_id long, turn_index int, speaker string, scrubbed_text string, is_canned boolean",
    )
    got = {r["conv_id"]: r["resolution_label"] for r in resolve_turns(turns, ["conv_id"]).collect()}
    assert got == {1: "NO_BRAND_REPLY", 2: "DEFLECTED_UNVERIFIED"}


def test_masking_skips_rules_whose_mark_is_absent(spark):
    """Patterns that are not known to need a mark are tried on every text, and give the same."""
    import dataclasses

    from replyloom import defaults as D
    from replyloom.functions.privacy import MaskRules, mask_steps

    texts = [
        None, "", "plain words, code 12", "@Delta @a_b hi", "mail x.y@z.org now", "see https://www.delta.com/x and http://t.co/q",
        "http:\x01//bit.ly/a \x02@c", "http://a@b.com/x@y call 555-123-4567", "\x01\x02\x01\x02\x01\x02\x01\x02", "Flight 12 pnr ABC123 @", "://",
        "http://other.net/z @delta", "card 4111 1111 1111 1111 http//x.org",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def masked(rules):
        out, counts = mask_steps(F.col("t"), rules)
        return df.select("t", out.alias("out"), *[c.alias(k) for k, c in counts.items()])

    rules = MaskRules()
    other = dataclasses.replace(rules, url=rules.url + "(?:)", email=rules.email + "(?:)", handle=rules.handle + "(?:)")
    guarded, tried = masked(rules), masked(other)
    assert guarded.collect() == tried.collect()
    assert "case when contains" in guarded._jdf.queryExecution().analyzed().toString().lower()
    # a token that brings the mark in leaves no rule out
    brought = masked(dataclasses.replace(rules, flight_prefix="@fl")).where("t = 'Flight 12 pnr ABC123 @'").first()
    assert brought["handles"] == 1 and D.URL == rules.url


def test_latin_words_are_found_without_a_function_of_one_word(spark):
    """The pattern finds what a condition on every run of word characters finds."""
    rng = random.Random(4)
    signs = ["a", "b", "z", "Q", " ", " ", "-", "_", "7", "\u00e9", "\u0130", "\U0001d41a", "\U0001f600", "\u0301", "\n", "\u0661"]
    said = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(400)] + [None, ""]
    runs = F.regexp_extract_all(F.lower("x"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    want = F.filter(runs, lambda w: w.rlike("^[a-z]{2,}$"))
    rows = spark.createDataFrame([(x,) for x in said], "x string").select(latin_words(F.col("x")).alias("got"), want.alias("want")).collect()
    assert all(r["got"] == r["want"] for r in rows) and sum(len(r["got"] or []) for r in rows) > 100


@pytest.mark.parametrize("n", [1, 2])
def test_grams_are_counted_without_functions_of_one_element(spark, n):
    rows = [("a", "to be or not to be"), ("a", "to be"), ("a", None), ("b", "x 1"), (None, "Not to be")]
    counted = distinct_n(spark.createDataFrame(rows, "brand string, text string"), ["brand"], n)
    assert "lambda" not in counted._jdf.queryExecution().optimizedPlan().toString()
    want = {("a", 4, 8), (None, 3, 3)} if n == 1 else {("a", 4, 6), (None, 2, 2)}
    assert {(r["brand"], r["unique_grams"], r["total_grams"]) for r in counted.collect()} == want
