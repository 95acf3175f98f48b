"""Connected components of a table of links, by repeated minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    A round gives each node the smallest label among its neighbours and then the label of its label,
    so chains shrink by more than half; a star needs one round. Labels are partly aggregated, so a
    node with very many links is one row per task.
    """
    both = store(links.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(
        links.select(F.col(b).alias("node"), F.col(a).alias("other"))).where("node <> other").distinct(), "component-links")
    labels = store(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")), "component-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("near")), "other")
        low = seen.groupBy("node").agg(F.min("near").alias("near"))
        stepped = labels.join(low, "node").select("node", "component", F.least("component", "near").alias("next"))
        # pointer jumping: the label of the new label
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        fresh = store(stepped.join(jump, "next", "left").select("node", "component", F.least("next", "far").alias("next")), "component-labels")
        labels = fresh.select("node", F.col("next").alias("component"))
        if not fresh.where("component <> next").limit(1).count():
            return labels
