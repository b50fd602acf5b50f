"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmgauge.llm.common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the least node that links reach.

    Large-star and small-star steps alternate until nothing changes: about the logarithm of the
    longest path many times. Each step is a grouped minimum and a join on the node; a node with very
    many links is combined before the shuffle and its join is one that Spark splits.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = stored(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            low.select("u", F.col("m").alias("v"))).distinct(), "small")
        same = not edges.join(small, ["u", "v"], "left_anti").head(1)
        dropped(edges, large)
        if same:
            break
        edges = small
    stars = small.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after new ``links`` (a, b) between nodes, labelled or not."""
    def named(df: DataFrame, side: str) -> DataFrame:
        return df.join(labels.select(F.col("node").alias(side), "label"), side, "left").withColumn(
            side, F.coalesce("label", side)).drop("label")

    merged = stored(components(named(named(links, "a"), "b")), "merged")
    renamed = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select(
        "node", F.coalesce("new", "label").alias("label"))
    fresh = merged.join(labels.select("node"), "node", "left_anti")
    return stored(renamed.unionByName(fresh), "labels")
