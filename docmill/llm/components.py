"""Connected components of a link table, each step a join of small rows that are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """links: a, b. Returns v, label: for each id in a link the smallest id that it reaches.

    Each round takes the smallest label among neighbours, then the label of that label; the number of rounds grows with
    the logarithm of the longest chain for most shapes, and ends when no label changes.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), name)
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), name)
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("seen"))
        step = labels.join(near, F.col("v") == F.col("a"), "left").select("v", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        far = step.select(F.col("v").alias("at"), F.col("label").alias("there"))
        step = step.join(far, F.col("label") == F.col("at"), "left").select("v", "old", F.least("label", "there").alias("label"))
        step = written(step, name)
        labels = step.select("v", "label")
        if step.filter("label != old").isEmpty():
            return labels


def extended(labels: DataFrame, links: DataFrame, name: str = "components") -> DataFrame:
    """components() of the links that labels came from and of more links (a, b). Only labels that these join are looked at."""
    at = [labels.select(F.col("v").alias(c), F.col("label").alias(f"of_{c}")) for c in ("a", "b")]
    ends = links.join(at[0], "a", "left").join(at[1], "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(ends.filter("a != b"), name).select(F.col("v").alias("old"), F.col("label").alias("new"))
    fresh = links.select(F.col("a").alias("v")).union(links.select("b")).distinct().join(labels, "v", "left_anti").select("v", F.col("v").alias("label"))
    return written(labels.unionByName(fresh).join(joined, F.col("label") == F.col("old"), "left").select("v", F.coalesce("new", "label").alias("label")), name)
