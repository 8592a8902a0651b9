"""Connected components by joins: least labels spread along edges, then labels are followed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Staged


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): the least node that is reachable.

    Each round takes every node's least label among itself and its neighbours and then that
    label's own label, so stars end in two rounds and chains in logarithmically many.
    """
    both = Staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges").df
    labels = Staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(rounds):
        spread = (
            both.join(labels.df.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
            .join(labels.df, "node").select("node", F.least("near", "component").alias("to"), F.col("component").alias("was"))
        )
        follow = labels.df.select(F.col("node").alias("to"), F.col("component").alias("next"))
        new = Staged(spread.join(follow, "to").select("node", F.least("to", "next").alias("component"), "was"), "labels")
        changed = new.df.where("component != was").limit(1).count()
        labels.drop()
        labels = new
        if not changed:
            return labels.df.select("node", "component")
    raise RuntimeError("components did not settle")
