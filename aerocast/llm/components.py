"""Connected components of a graph of links, as DataFrames throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerocast.llm.common import written


def components(links: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, label) of every node of the links (a, b); label is the smallest node reachable.

    Each round every node, and the node that its label names, takes the smallest label
    among its neighbours, and then the label of its label; labels only fall, and the rounds
    needed grow with the logarithm of the longest path. Links may repeat, go either way or
    join a node to itself; null ends are ignored; without links the result is empty. Its tables
    go to ``folder``, or to the shared one.
    """
    ends = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = written(ends.union(ends.select("b", "a")).distinct(), "edges", folder)
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels", folder)
    while True:
        near = (edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        own = labels.join(near, "node")
        falls = (own.select("node", "near").union(own.select(F.col("label").alias("node"), "near"))
                 .groupBy("node").agg(F.min("near").alias("near")))
        lower = labels.join(falls, "node", "left").select("node", "label", F.least("label", "near").alias("now"))
        lower = written(lower, "lower", folder)
        of_label = lower.select(F.col("node").alias("now"), F.col("now").alias("next"))
        after = written(lower.join(of_label, "now").select("node", "label", F.least("now", "next").alias("after")), "labels", folder)
        changed = after.filter("label <> after").limit(1).count()
        labels = after.select("node", F.col("after").alias("label"))
        if not changed:
            return labels
