"""Connected components of a graph of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str = "components") -> DataFrame:
    """Rows (node, component) for edges (a, b): component is the smallest node reachable.

    Each round takes the least label among a node's neighbours and then the
    label of that label, so rounds grow with the logarithm of a chain's length.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = scratch.keep(both, f"{label}-edges")
    now = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), f"{label}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(now.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = now.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        up = now.select(F.col("node").alias("next"), F.col("component").alias("up"))
        least = least.join(up, "next", "left").select("node", F.least("next", F.coalesce("up", "next")).alias("component"), (F.least("next", F.coalesce("up", "next")) < F.col("component")).alias("moved"))
        new = scratch.keep(least, f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}")
        now = new.select("node", "component")
        if new.where("moved").isEmpty():
            scratch.drop(f"{label}-edges")
            return now
