"""Explicit schemas of every table the library reads or writes."""

from pyspark.sql import types as T

POST_CSV = T.StructType(
    [
        T.StructField("tweet_id", T.LongType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("inbound", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("response_tweet_id", T.StringType()),
        T.StructField("in_response_to_tweet_id", T.StringType()),
    ]
)

POST = T.StructType(
    [
        T.StructField("tweet_id", T.LongType()),
        T.StructField("author_id", T.StringType()),
        T.StructField("inbound", T.BooleanType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("text", T.StringType()),
        T.StructField("in_reply_to", T.LongType()),
        T.StructField("response_ids", T.ArrayType(T.LongType())),
    ]
)

TURN = T.StructType(
    [
        T.StructField("turn_index", T.IntegerType()),
        T.StructField("tweet_id", T.LongType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("scrubbed_text", T.StringType()),
        T.StructField("is_canned", T.BooleanType()),
        T.StructField("macro_type", T.StringType()),
        T.StructField("gap_from_prev_hours", T.DoubleType()),
    ]
)

FLAGS = T.StructType(
    [
        T.StructField("multi_agent_handoff", T.BooleanType()),
        T.StructField("temporal_gap_gt_24h", T.BooleanType()),
        T.StructField("is_pure_canned_deflection", T.BooleanType()),
    ]
)

THREAD = T.StructType(
    [
        T.StructField("thread_id", T.StringType()),
        T.StructField("root_tweet_id", T.LongType()),
        T.StructField("leaf_tweet_id", T.LongType()),
        T.StructField("num_turns", T.IntegerType()),
        T.StructField("customer_inquiry_text", T.StringType()),
        T.StructField("initial_brand_reply", T.StringType()),
        T.StructField("turns", T.ArrayType(TURN)),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("agent_signatures", T.ArrayType(T.StringType())),
                    T.StructField("flags", FLAGS),
                ]
            ),
        ),
    ]
)

GOLD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("actual_historical_reply", T.StringType()),
        T.StructField("ground_truth_escalate", T.IntegerType()),
        T.StructField("ground_truth_intent", T.StringType()),
        T.StructField("human_rationale", T.StringType()),
        T.StructField("labeled_at", T.StringType()),
        T.StructField("corrected_at", T.StringType()),
    ]
)

RUBRIC = T.StructType(
    [
        T.StructField("factual_grounding", T.DoubleType()),
        T.StructField("safety_compliance", T.DoubleType()),
        T.StructField("actionability", T.DoubleType()),
        T.StructField("tone_empathy", T.DoubleType()),
    ]
)

RATING = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("system_reply", T.StringType()),
        T.StructField("human_scores", RUBRIC),
        T.StructField("human_overall_score", T.DoubleType()),
        T.StructField(
            "judge_scores",
            T.StructType([*RUBRIC.fields, T.StructField("overall_score", T.DoubleType())]),
        ),
        T.StructField("delta_score", T.DoubleType()),
        T.StructField("human_notes", T.StringType()),
        T.StructField("scored_at", T.StringType()),
    ]
)

RELABEL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("original_escalate", T.IntegerType()),
        T.StructField("blind_relabel_escalate", T.IntegerType()),
        T.StructField("is_consistent", T.BooleanType()),
    ]
)

#: tier -> intent -> policy, as the taxonomy file stores it
TAXONOMY = T.MapType(
    T.StringType(),
    T.MapType(
        T.StringType(),
        T.StructType(
            [
                T.StructField("description", T.StringType()),
                T.StructField("action_policy", T.StringType()),
                T.StructField("override", T.BooleanType()),
                T.StructField("sub_intents", T.ArrayType(T.StringType())),
            ]
        ),
    ),
)
