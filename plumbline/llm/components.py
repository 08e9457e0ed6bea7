"""Connected components of a graph given as a table of edges, by min-label hooking and pointer jumping.

Every round is written to the shared folder, so that lineage stays short and a lost executor costs one round. Labels
only fall, so the loop ends; chains halve with each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the component's smallest node. Loops and repeats are allowed."""
    both = stored(edges.where("a <> b").selectExpr("a", "b").union(edges.where("a <> b").selectExpr("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        # The least label among neighbours goes to the node and, by hooking, to the node's root.
        seen = both.join(labels.selectExpr("node as b", "root as other"), "b").groupBy("a").agg(F.min("other").alias("other"))
        met = labels.join(seen, F.col("node") == F.col("a")).select("node", "root", F.least("root", "other").alias("low"))
        hooks = met.selectExpr("node", "low").union(met.selectExpr("root as node", "low")).groupBy("node").agg(F.min("low").alias("root"))
        jumped = hooks.alias("x").join(hooks.selectExpr("node as up", "root as upper").alias("y"), F.col("x.root") == F.col("y.up"), "left")
        new = stored(jumped.select("node", F.least("root", F.coalesce("upper", "root")).alias("root")), "labels")
        if new.join(labels, "node").where(new["root"] != labels["root"]).isEmpty():
            return new
        labels = new
