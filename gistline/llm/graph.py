"""Connected components by random contraction, on tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistline.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v): nodes of one component share one root.

    Each round orders the nodes anew by a hash. A node moves to the first node among itself and
    its neighbours, and edges are relabelled; inner edges vanish. A constant share of the nodes goes
    each round, whatever the shape, so the rounds grow with the logarithm of the graph. A node with
    many edges is one row per task before it is shuffled, and its join can be split.
    """
    edges = common.stored(edges.select("u", "v").where("u <> v").distinct())
    labels, turn = None, 0
    while True:
        def order(c: str, turn: int = turn):
            return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("node"))

        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = common.stored(
            both.groupBy("u").agg(F.min(order("v")).alias("best")).select("u", F.least("best", order("u"))["node"].alias("p"))
        )
        if labels is None:
            labels = common.stored(parents.select(F.col("u").alias("node"), F.col("p").alias("root")))
        else:
            moved, old = parents.select(F.col("u").alias("root"), "p"), labels
            labels = common.stored(old.join(moved, "root", "left").select("node", F.coalesce("p", "root").alias("root")))
            common.discard(old)
        old, edges = edges, common.stored(
            edges.join(parents, "u").select(F.col("p").alias("a"), F.col("v").alias("u"))
            .join(parents, "u").select(F.col("a").alias("u"), F.col("p").alias("v"))
            .where("u <> v").distinct()
        )
        common.discard(old, parents)
        if edges.isEmpty():
            common.discard(edges)
            return labels
        turn += 1
