"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the component's least node.

    Alternating large-star and small-star steps: each links the neighbours of a node to the
    least node around it, until every node points at its root. A node with very many
    neighbours is only ever a key of joins whose both sides are exchanged, so adaptive
    execution can split it. With ``scratch`` the tables of the steps can be deleted later.
    """
    written = (scratch or Scratch(edges.sparkSession)).written
    down = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    current = written(edges.select(*down).filter("a <> b").distinct(), "links")
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        least = written(least.withColumnRenamed("a", "u"), "least")
        large = both.filter("b > a").join(least, F.col("a") == F.col("u"))
        large = written(large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "least")
        small = large.join(least, F.col("a") == F.col("u")).filter("b <> m")
        pointed = small.select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = written(pointed.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
