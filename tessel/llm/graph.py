"""Connected components of a graph given as a table of edges, by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(a, b) long edges -> (node, label): label is the same for two nodes exactly if a path joins them.

    Every round each node hooks on to its neighbour of lowest priority if that is below its own; priorities
    are hashes that change with the round, so a constant share of the nodes is expected to go each time, whatever
    the shape (chains included). Contracted edges are written to the shared folder between rounds. Nodes without
    edges do not occur in the result. An empty table gives an empty one; null ends are ignored.
    """
    spark = edges.sparkSession
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), folder, "edges0")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    turn = 0
    while not edges.isEmpty():
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.col(c), F.lit(t)), F.col(c))
        ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        best = ends.groupBy("a").agg(F.min(rank("b")).alias("m"))
        hook = saved(best.select("a", F.when(F.col("m") < rank("a"), F.col("m")["b"]).otherwise(F.col("a")).alias("to")), folder, f"hook{turn}")
        again = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
        hook = saved(hook.join(again, "to", "left").select("a", F.coalesce("next", "to").alias("to")), folder, f"jump{turn}")
        step = hook.select(F.col("a").alias("label"), "to")
        labels = saved(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), folder, f"labels{turn}")
        moved = edges.join(hook.withColumnRenamed("to", "a2"), "a").join(hook.select(F.col("a").alias("b"), F.col("to").alias("b2")), "b")
        edges = saved(moved.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), folder, f"edges{turn + 1}")
        for old in (f"edges{turn}", f"hook{turn}", f"jump{turn}", f"labels{turn - 1}"):
            discard(spark, f"{folder}/{old}")
        turn += 1
    return labels
