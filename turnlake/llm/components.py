"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.store import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), both long; root is its smallest node.

    Each round maps a node to its smallest neighbour and renames the ends of all edges, until
    no edge is left. A node of very high degree is one row of a partial aggregation and one
    key of a join that adaptive execution can split; neighbours are never collected.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = written(nodes.withColumn("root", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        nearest = written(nearest, "nearest")
        edges = (
            edges.join(nearest, "a")
            .select(F.col("to").alias("a"), "b")
            .join(nearest.withColumnsRenamed({"a": "b", "to": "t"}), "b")
            .select("a", F.col("t").alias("b"))
            .where("a <> b")
            .distinct()
        )
        edges = written(edges, "edges")
        labels = labels.join(nearest.withColumnRenamed("a", "root"), "root", "left")
        labels = labels.select("node", F.coalesce("to", "root").alias("root"))
        labels = written(labels, "labels")
    return labels
