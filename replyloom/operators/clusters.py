"""Cluster summaries, representatives and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from replyloom.operators.gold import hash_sample
from replyloom.operators.tfidf import top_terms
from replyloom.runtime import salted_join

NOISE = -1


def cluster_sizes(labels: DataFrame, label: str = "label") -> DataFrame:
    """Members of each cluster, noise left out."""
    return (
        labels.where(F.col(label) != NOISE).groupBy(label).agg(F.count(F.lit(1)).alias("members"))
    )


def cluster_summary(labels: DataFrame, label: str = "label") -> DataFrame:
    """One row: number of clusters, noise rows and their share."""
    sizes = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    noise = F.sum(F.when(F.col(label) == NOISE, F.col("n")).otherwise(0))
    return sizes.agg(
        F.count_if(F.col(label) != NOISE).alias("clusters"),
        noise.alias("noise"),
        (noise / F.sum("n")).alias("noise_share"),
    )


def cluster_top(labels: DataFrame, k: int = 12, label: str = "label") -> DataFrame:
    """The k largest clusters."""
    return cluster_sizes(labels, label).orderBy(F.desc("members"), label).limit(k)


def representatives(
    vectors: DataFrame, k: int = 3, label: str = "label", id_col: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """The k members nearest to the centroid of each cluster by cosine.

    Coordinates are averaged with a map-side combine, so a cluster is never gathered; the
    centroids have one short row per cluster.
    """
    clustered = vectors.where(F.col(label) != NOISE).select(
        label, id_col, F.transform(vector, lambda x: x.cast("double")).alias("_v")
    )
    centroid = (
        clustered.select(label, F.posexplode("_v").alias("_i", "_x"))
        .groupBy(label, "_i")
        .agg(F.avg("_x").alias("_m"))
        .groupBy(label)
        # one entry per dimension
        .agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_c"))
        .select(label, F.transform("_c", lambda e: e["_m"]).alias("_c"))
    )

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    v, c = F.col("_v"), F.col("_c")
    rank = W.partitionBy(label).orderBy(F.desc("similarity"), id_col)
    return (
        salted_join(clustered, centroid, [label], spread=[id_col])
        .withColumn(
            "similarity",
            F.round(
                F.try_divide(dot(v, c), F.sqrt(dot(v, v)) * F.sqrt(dot(c, c))), 9
            ),
        )
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
        .select(label, "rank", id_col, "similarity")
    )


def cluster_profiles(
    labels: DataFrame, weights: DataFrame, vectors: DataFrame, id_col: str, label: str = "label",
    k_terms: int = 10, k_members: int = 3, vector: str = "embedding",
) -> DataFrame:
    """Size, top terms and representative members of every cluster, largest first.

    ``labels`` has (id, label), ``weights`` (id, term, weight), ``vectors`` (id, vector).
    """
    sizes = cluster_sizes(labels, label)
    kept = labels.where(F.col(label) != NOISE)
    terms = top_terms(weights.join(kept, id_col), [label], k_terms, sizes)
    near = representatives(vectors.join(kept, id_col), k_members, label, id_col, vector)

    def listed(df: DataFrame, value: str, name: str) -> DataFrame:
        # at most k entries per cluster
        ranked = F.array_sort(F.collect_list(F.struct("rank", value)))
        return df.groupBy(label).agg(F.transform(ranked, lambda e: e[value]).alias(name))

    return (
        sizes.join(listed(terms, "term", "top_terms"), label, "left")
        .join(listed(near, id_col, "representatives"), label, "left")
        .orderBy(F.desc("members"), label)
    )


def sample_inquiries(
    inquiries: DataFrame, id_col: str, n: int | None = None, seed: int = 42
) -> DataFrame:
    """The inquiries to cluster: all, or a stable sample of n."""
    return inquiries if n is None else hash_sample(inquiries, id_col, seed, n)

