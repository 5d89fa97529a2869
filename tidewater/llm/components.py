"""Connected components over an edge table, by alternating neighbour minima and pointer jumping.

Every round each node takes the smallest label among itself, its neighbours and the node that its label names; labels only fall
and rounds end when none does. A node with very many edges costs no more than its rows: minima are pre-aggregated before the
shuffle and skewed joins are split by Spark. Labels are written to the shared folder every round, never gathered.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import delete, materialize

MOST_ROUNDS = 200


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: src, dst. Returns node, component (the smallest node reachable) for every node of an edge."""
    spark = edges.sparkSession
    both = edges.filter("src <> dst").select("src", "dst").unionByName(edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both, _ = materialize(both.distinct(), "edges")
    labels, old = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("component")), "labels")
    for _ in range(MOST_ROUNDS):
        by_neighbour = both.join(labels, both.dst == labels.node).select(F.col("src").alias("node"), "component")
        hop = labels.alias("a").join(labels.alias("b"), F.col("a.component") == F.col("b.node")).select(F.col("a.node"), F.col("b.component"))
        # the label's own node learns of the smaller label too, which halves long chains
        hook = by_neighbour.alias("n").join(labels.alias("l"),
            F.col("n.node") == F.col("l.node")).filter("n.component < l.component").select(F.col("l.component").alias("node"), F.col("n.component"))
        new = labels.select("node", "component", F.col("component").alias("was")).unionByName(
            by_neighbour.unionByName(hop).unionByName(hook).groupBy("node").agg(F.min("component").alias("component")).withColumn("was", F.lit(None).cast("long"))
        ).groupBy("node").agg(F.min("component").alias("component"), F.max("was").alias("was"))
        new, path = materialize(new, "labels")
        changed = new.filter("component < was").limit(1).count()
        delete(spark, old)
        labels, old = new.select("node", "component"), path
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
