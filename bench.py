"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from replyloom.registry import ENTRIES  # noqa: E402

HEADLINE = (
    "thread_depth", "thread_flags", "thread_turns", "ancestor_closure", "brand_profile",
    "distinct_bigrams", "pii_scrub", "pii_totals", "guardrail_hits", "rule_classify",
    "resolution_turns", "judge_scores", "term_statistics", "tfidf_weights", "retrieve_weighted",
    "cost_curve", "pr_auc", "kappa", "quota_sample", "representatives", "density_cluster",
    "escalation_model", "nmf_topics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("replyloom-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    ENTRIES["class_balance"][0](spark, folder).collect()  # start-up is not a query's time
    times = {}
    for name in names:
        start = time.perf_counter()
        ENTRIES[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
