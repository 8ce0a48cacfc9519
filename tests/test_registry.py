"""Every registered query against its SQL oracle, or for rows where SQL cannot express it."""

import pytest

import __spark_entry__ as entry
from oracle import connect, differences

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
#: rule queries and the column whose outcomes must differ, or the rule never fired
OUTCOMES = {
    "guardrail_hits": "category", "intent_tags": "tags", "rule_classify": "intent",
    "keyword_router": "intent", "severity_tier": "primary_tier", "resolution_turns": "resolution_label",
    "canned_type": "kind", "score_tiers": "tier", "protection_check": "proof_status",
    "route_scores": "predicted_intent", "coarse_class": "coarse", "template_reply": "reply",
    "choose_reply": "generated_reply", "density_cluster": "label",
}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    got = QUERIES[name](spark, data).toPandas()
    assert len(got) > 0
    if name in OUTCOMES:
        assert got[OUTCOMES[name]].nunique(dropna=False) >= 2
    if name in ORACLE:
        assert differences(got, con.execute(ORACLE[name]).df()) is None


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).count() == 1
