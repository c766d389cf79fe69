"""Connected components of an edge table, in Spark (no links or labels reach the driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (v, root): for each vertex on an edge the smallest vertex of its component.

    Each round takes the least label among the neighbours, hooks the old label's vertex to it as well,
    and then jumps to the label's own label; it ends when no label changes, after a number of rounds in
    the order of the logarithm of the longest path. Labels are written to the shared folder each round.
    Joins have one row per vertex on one side, so a vertex or label with many rows can be split.
    """
    edges = edges.select("a", "b").filter("a != b")
    both = written(edges.union(edges.select("b", "a")).distinct().toDF("a", "b"), "edges")
    label = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "v"), "labels")
    while True:
        near = both.join(label.select(F.col("v").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near.withColumnRenamed("a", "v"), "v")
        own = step.select("v", F.least("root", "near").alias("root"))
        hook = step.filter("near < root").select(F.col("root").alias("v"), F.col("near").alias("root"))
        new = own.union(hook).groupBy("v").agg(F.min("root").alias("root"))
        jump = new.withColumnsRenamed({"v": "w", "root": "far"})
        new = written(new.join(jump, F.col("root") == F.col("w"), "left").select("v", F.least("root", "far").alias("root")), "labels")
        moved = new.join(label.withColumnRenamed("root", "old"), "v").filter("root != old").limit(1).count()
        removed(label.sparkSession, label)
        label = new
        if not moved:
            removed(both.sparkSession, both)
            return label
