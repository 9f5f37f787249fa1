"""Connected components over an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._work import Work


def connected_components(work: Work, edges: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``; label is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours (combined before the
    shuffle, so a hub costs no single task its neighbours) and then jumps to the label's
    own label, which halves long paths. Every round is a written table. The arcs of a hub meet
    its label in a join whose sides are both fresh exchanges, which adaptive execution splits.
    ``rows`` bounds the number of edges, if known.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = work.save(both, f"{tag}-arcs", rows=rows and 2 * rows)
    n = both.count()
    labels = work.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{tag}-0", rows=n)
    round_no = 0
    while True:
        round_no += 1
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("next"))
        jumped = hooked.join(labels.select(F.col("node").alias("next"), F.col("label").alias("beyond")), "next", "left")
        new = jumped.select("node", F.least("next", "beyond").alias("label"), (F.least("next", "beyond") < F.col("label")).alias("moved"))
        new = work.save(new, f"{tag}-{round_no}", rows=n)
        work.drop(f"{tag}-{round_no - 1}")
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            work.drop(f"{tag}-arcs")
            return labels
