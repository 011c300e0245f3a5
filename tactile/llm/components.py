"""Connected components of links, by labels that flow along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tactile.llm.common import store

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``links`` (``a, b`` longs): the label is the smallest node
    reachable. Links are few against rows; a node may have any number of them.

    Each round takes the smallest label among neighbours, then the label of that label, so long
    chains shrink by jumps. All rounds are stored, and the minimum is taken before the shuffle.
    """
    both = store(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    for _ in range(MOST_ROUNDS):
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label")
        best = near.unionByName(labels).groupBy("node").agg(F.min("label").alias("near"))
        roots = labels.select(F.col("node").alias("near"), F.col("label").alias("jump"))
        new = store(best.join(roots, "near").select("node", F.col("jump").alias("label")), "labels")
        old = labels.select("node", F.col("label").alias("old"))
        changed = new.join(old, "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError("the links form chains beyond the number of rounds")
