import json

import pytest
from pyspark.sql import functions as F

from replyloom.functions.rules import severity_tier
from replyloom.operators import gold as G
from replyloom.schemas import RELABEL
from replyloom.sources import posts as SP
from replyloom.sources import threads as ST

CSV = '''tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id
1,105,True,Wed Oct 11 06:55:44 +0000 2017,"@Delta my ""bag""
is lost, help",2,
2,Delta,False,Wed Oct 11 07:55:44 +0000 2017,"Sorry, we look *AB","3,4",1.0
3,105,True,not a time,ok,,2
'''


def test_posts_from_csv(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text(CSV)
    rows = {r["tweet_id"]: r for r in SP.read_posts(spark, str(path)).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1]["text"] == '@Delta my "bag"\nis lost, help' and rows[1]["inbound"] is True
    assert rows[1]["in_reply_to"] is None and rows[2]["in_reply_to"] == 1
    assert rows[2]["response_ids"] == [3, 4] and rows[2]["inbound"] is False
    assert rows[3]["created_at"] is None and rows[2]["created_at"].year == 2017


THREAD = {
    "thread_id": "t", "root_tweet_id": 1, "leaf_tweet_id": 2, "num_turns": 2,
    "customer_inquiry_text": "q", "initial_brand_reply": "r",
    "turns": [{"turn_index": 0, "tweet_id": 1, "speaker": "customer", "scrubbed_text": "q",
               "is_canned": False, "macro_type": None, "gap_from_prev_hours": 0.0}],
    "metadata": {"agent_signatures": ["^A"], "flags": {
        "multi_agent_handoff": False, "temporal_gap_gt_24h": False,
        "is_pure_canned_deflection": False}},
}


def test_thread_files(spark, tmp_path):
    source = tmp_path / "threads.json"
    rows = [{**THREAD, "root_tweet_id": i, "leaf_tweet_id": i} for i in range(30)]
    source.write_text(json.dumps(rows, indent=2))
    lines = str(tmp_path / "lines")
    ST.convert_json_to_jsonl(spark, str(source), lines, cap=20)
    threads = ST.read_threads(spark, lines)
    assert threads.count() == 20 and threads.first()["metadata"]["agent_signatures"] == ["^A"]
    ST.write_threads(threads, str(tmp_path / "all"), str(tmp_path / "sample"), 5)
    sample = ST.read_threads(spark, str(tmp_path / "sample")).collect()
    assert sorted(r["root_tweet_id"] for r in sample) == [0, 1, 2, 3, 4]
    assert ST.read_threads(spark, str(tmp_path / "all"), max_rows=7).count() == 7


def test_blank_lines_are_skipped(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text(json.dumps(THREAD) + "\n\n" + json.dumps(THREAD) + "\n")
    assert ST.read_threads(spark, str(path)).count() == 2


def test_reports_and_arrays(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1, 0, False)], RELABEL)
    ST.write_report(df, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    ST.write_report(df, str(tmp_path / "json"))
    path = tmp_path / "array.json"
    path.write_text(json.dumps([{"id": "a", "original_escalate": 1}, {"id": "b"}]))
    assert ST.read_json_array(spark, str(path), RELABEL).count() == 2
    with pytest.raises(ValueError):
        ST.write_report(df, str(tmp_path / "x"), "xml")


def test_data_gate(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id int, y int")
    assert ST.require(df, 3, "y", 2) is df
    with pytest.raises(ValueError, match="rows"):
        ST.require(df, 4)
    with pytest.raises(ValueError, match="classes"):
        ST.require(df.where("y = 0"), 2, "y")


def test_taxonomy(spark, tmp_path):
    path = tmp_path / "taxonomy.json"
    path.write_text(json.dumps({
        "TIER_0": {"SAFETY": {"description": "d", "action_policy": "call", "override": True}},
        "TIER_1": {"BAGS": {"sub_intents": ["LOST", "BROKEN"]}, "SEATS": {"sub_intents": ["UP"]}},
    }))
    rows = {tuple(r) for r in ST.read_taxonomy(spark, str(path)).collect()}
    assert rows == {
        ("TIER_0", "SAFETY", None, True, "call"), ("TIER_1", "BAGS", "LOST", False, None),
        ("TIER_1", "BAGS", "BROKEN", False, None), ("TIER_1", "SEATS", "UP", False, None),
    }
    assert spark.range(1).select(severity_tier(F.lit("High"))).first()[0].startswith("TIER_1")


def test_showcase_categories(spark):
    flags = {"multi_agent_handoff": True, "temporal_gap_gt_24h": False,
             "is_pure_canned_deflection": False}
    masked = "<PNR_CONFIRMATION_CODE> on <FLIGHT_NUM:DL12>"
    rows = [
        {**THREAD, "root_tweet_id": i, "turns": [{**THREAD["turns"][0], "scrubbed_text": masked}],
         "metadata": {"agent_signatures": [], "flags": flags}} for i in range(4)
    ]
    from replyloom.schemas import THREAD as SCHEMA

    got = G.showcase(spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert sorted((r["category"], r["root_tweet_id"]) for r in got) == [
        ("multi_agent_handoff", 0), ("multi_agent_handoff", 1), ("pii_scrubbed_pnr_flight", 0),
        ("pii_scrubbed_pnr_flight", 1),
    ]
