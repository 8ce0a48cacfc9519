"""Routing of live posts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from replyloom import defaults as D
from replyloom.functions.privacy import MaskRules, scrub
from replyloom.plans.escalation import Rules, TextClassifier
from replyloom.plans.systems import route

#: A classifier, or a function that adds the probability ``p`` row by row.
Scorer = TextClassifier | Callable[[DataFrame], DataFrame]


def route_stream(
    posts: DataFrame, classifier: Scorer, tau: float, text: str = "text",
    rules: Rules = D.GUARDRAIL, group: int = 0, mask: MaskRules = MaskRules(),
) -> DataFrame:
    """Mask, score and route posts of a batch or streaming DataFrame.

    Every step works on one row alone, so the query keeps no state and needs no watermark.
    """
    masked = posts.withColumn(text, scrub(F.col(text), mask))
    if isinstance(classifier, TextClassifier):
        scored = (
            classifier.probabilities(masked, text)
            .withColumn("p", F.col("_probabilities")[1])
            .drop("_probabilities")
        )
    else:
        scored = classifier(masked)
    return route(scored, tau, text=text, rules=rules, group=group)


def route_files(
    spark: SparkSession, source: str, schema: StructType, folder: str, classifier: Scorer,
    tau: float, files: int | None = None, **options,
) -> DataFrame:
    """Route all Parquet files of ``source`` that were not routed yet, and read back all answers.

    ``folder`` keeps the answers and the checkpoint: a later call with the same folder routes new
    files only, and what a stopped run left half done is done once. ``files`` are taken in one
    micro-batch at most.
    """
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    routed = route_stream(reader.parquet(source), classifier, tau, **options)
    (
        routed.writeStream.format("parquet")
        .option("path", f"{folder}/answers")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(routed.schema).parquet(f"{folder}/answers")
