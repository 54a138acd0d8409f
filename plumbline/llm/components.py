"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: the smallest node that each node of the links reaches.

    Every round gives each node the smallest label among its neighbours' and then follows that label once more, so
    paths shorten by more than half. Each round is written to the shared folder; it ends when no label changes.
    """
    scratch = Scratch()
    edges = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    edges = scratch.write(edges.union(edges.select("other", "node")).distinct(), "edges")
    labels = table = scratch.write(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("jump"))
        moved = step.join(jump, "next", "left").select("node", F.col("component").alias("old"), F.least("next", F.coalesce("jump", "next")).alias("component"))
        moved = scratch.write(moved, "labels")
        scratch.drop(table)
        table, labels = moved, moved.select("node", "component")
        if moved.where("old <> component").isEmpty():
            scratch.drop(edges)
            return labels
