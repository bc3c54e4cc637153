"""Connected components of a graph of links, by turns of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A node that has this share of the links' ends is a hub, so that there are at most a thousand of them.
HUB = 0.001


def components(edges: DataFrame, table) -> DataFrame:
    """Rows (node, label) of the nodes that have a link; the label is the least node of the component.

    ``edges`` has columns ``u`` and ``v``; ``table`` writes rows and reads them back.  A turn links
    each node's larger neighbours to its least one, then its smaller ones; the number of turns
    grows with the logarithm of the longest path.  Every step is a partial sum or an
    equality join on narrow rows.
    """
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
        """The rows with ``m``, their node's least neighbour; that of hubs, at most ``1 / HUB`` nodes, is broadcast."""
        hub = F.col("n") >= HUB * total
        often, seldom = least.where(hub).drop("n"), least.where(~hub).drop("n")
        others = rows.join(F.broadcast(often.select("u")), "u", "left_anti")
        return rows.join(F.broadcast(often), "u").unionByName(others.join(seldom, "u"))

    now = table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (after := state(now)) != before:
        before = after
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")))
        large = with_least(both.where("v > u"), least, 2 * after[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = table(large)
        own = table(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = with_least(large, own, large.count())
        now = table(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            own.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
