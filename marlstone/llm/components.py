"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the least node of each component, for all nodes of ``edges`` (a, b).

    Alternates two steps until the edges form stars. Large star: each node
    sends its larger neighbours to its least one. Small star: it sends its
    smaller neighbours and itself there. Both are sums and joins over edges,
    whose number never grows by more than the number of nodes; each round is
    written to the shared folder.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "edges")
        changed = after.exceptAll(now).limit(1).count() + now.exceptAll(after).limit(1).count()
        now = after
        if not changed:
            roots = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
