"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``links(a, b)``; no links, no rows.

    Each round takes the least label of the neighbours and then the label of that label, so chains halve; labels are
    written to the shared folder after each round, which ends when none has changed. Loops and repeated links do no harm.
    """
    both = materialize(links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(links.select("b", "a")).distinct(), "links")
    # the first round needs no labels yet: the least of a node and its neighbours
    labels = materialize(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), "label"), "w").groupBy("v").agg(F.min("label").alias("near"))
        step = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("next"))
        target = labels.select(F.col("v").alias("next"), F.col("label").alias("far"))
        jumped = step.join(target, "next", "left").select("v", F.least("next", F.coalesce("far", "next")).alias("label"), (F.least("next", F.coalesce("far", "next")) < F.col("label")).alias("moved"))
        now = materialize(jumped, "labels")
        labels = now.select("v", "label")
        if now.filter("moved").isEmpty():
            return labels.select(F.col("v").alias("node"), F.col("label").alias("component"))
