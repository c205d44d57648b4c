"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

LINKS_PER_TASK = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that links reach) for all nodes of links(a, b).

    Each round takes the smallest label among the neighbours, then the label of that label, so that stars end at once and chains
    in about the logarithm of their length. Labels are cut from their lineage each round; nothing is gathered.
    """
    both = durable(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    parts = 1 + both.count() // LINKS_PER_TASK
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), parts)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("lower"))
        jump = labels.select(F.col("node").alias("lower"), F.col("component").alias("beyond"))
        after = durable(lower.join(jump, "lower").select("node", F.least("lower", "beyond").alias("component"), (F.least("lower", "beyond") != F.col("component")).alias("moved")), parts)
        labels = after.select("node", "component")
        if not after.filter("moved").limit(1).count():
            return labels


def merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels(node, component) once links(a, b) are added: only the components that they join are gone through again."""
    if labels is None:
        return components(links)
    end = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
    ends = links.select("a", "b").join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
    above = components(ends.filter("a <> b").distinct())
    old = labels.join(above.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    fresh = above.join(labels.select("node"), "node", "left_anti").select("node", "component")
    return durable(old.union(fresh), 1 + labels.count() // LINKS_PER_TASK)
