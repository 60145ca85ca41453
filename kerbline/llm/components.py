"""Connected components of an edge table, as DataFrame rounds over written label tables.

Each round gives a node the smallest label among its own, its neighbours', its label's label, and the
smallest label that any member of its tree has seen. Labels therefore fall along whole trees at once and
the number of rounds grows with the logarithm of a component's diameter. Labels and edges never leave the
executors; only the number of changed labels does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, label`` for each end of an edge in ``a, b``; the label is the component's smallest node.

    Edges with a null end, loops and repeated edges change nothing. No edges: an empty table.
    """
    e = edges.select("a", "b").where("a <> b")
    both = scratch.table(e.union(e.select("b", "a")).distinct(), "edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"), F.lit(1).alias("changed")), "labels")
    while True:
        now = labels.select("node", "label")
        top, at_a, at_b = (now.select(F.col("node").alias(n), F.col("label").alias(x)) for n, x in (("up", "top"), ("node_a", "of_a"), ("node_b", "of_b")))
        # edges within one label have done their part: label and members fall together from here
        following = scratch.table(both.select("a", "b").join(at_a, F.col("a") == F.col("node_a")).join(at_b, F.col("b") == F.col("node_b")).where("of_a <> of_b").select("a", "b", "of_a", "of_b"), "edges")
        found = following.select("a", "of_b").union(following.select(F.col("of_a").alias("a"), "of_b")).groupBy("a").agg(F.min("of_b").alias("low"))
        step = now.join(top, now.label == top.up).join(found, now.node == found.a, "left")
        new = F.least("label", "top", "low")
        step = scratch.table(step.select("node", new.alias("label"), F.when(new < F.col("label"), 1).otherwise(0).alias("changed")), "labels")
        scratch.drop(labels, both)
        labels, both = step, following
        if labels.where("changed = 1").isEmpty():
            break
    return labels.select("node", "label")
