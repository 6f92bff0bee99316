"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.sources.scratch import kept


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of the edges (a, b), two columns of numbers.

    Each round hooks every node to the least of its neighbours' labels and then follows the labels to their ends by doubling, so long chains take few rounds.  Rounds are written to the shared
    folder.  What moves is (node, label) and the edges whose ends differ still; edges inside one label are dropped.
    """
    both = kept(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = kept(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
    while True:
        while True:  # a label's own label is at least as low
            ends = labels.select(F.col("node").alias("root"), F.col("root").alias("end"))
            jumped = kept(labels.join(ends, "root").select("node", "end", (F.col("root") != F.col("end")).alias("moved")))
            labels = jumped.select("node", F.col("end").alias("root"))
            if jumped.where("moved").isEmpty():
                break
        at_a, at_b = labels.select(F.col("node").alias("a"), F.col("root").alias("x")), labels.select(F.col("node").alias("b"), F.col("root").alias("y"))
        open_ = kept(both.join(at_a, "a").join(at_b, "b").where("x <> y").select("a", "b", "x", "y"))
        if open_.isEmpty():
            return labels
        both = open_.select("a", "b")
        # A root takes the least label that an edge of its component leads to; the other nodes follow it in the next doubling.
        lower = open_.where("y < x").groupBy("x").agg(F.min("y").alias("low"))
        labels = kept(labels.join(lower, labels["node"] == lower["x"], "left").select("node", F.coalesce("low", "root").alias("root")))
