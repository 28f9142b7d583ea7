"""Connected components of a graph given as pairs, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passel.llm.tables import delete, stored


def _least(pairs: DataFrame) -> DataFrame:
    """Each node with the smallest node among itself and its neighbours."""
    return pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("p")).select("p.*")


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest node around it instead."""
    pairs = _both_ways(links)
    linked = pairs.join(_least(pairs), "u").where("v > u")
    return linked.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them; ``links`` has the larger node first."""
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    linked = links.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")
    return linked.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def _unsettled(links: DataFrame) -> int:
    """How many nodes are neither a centre only nor hang on one centre only; the centre is the smaller end."""
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")),
    )
    roles = links.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.hangs").alias("hangs"), F.max("e.holds").alias("holds"))
    return roles.where("hangs + holds > 1").count()


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node that the node reaches, for every node of the links (u, v).

    Large and small stars alternate until each node hangs on the smallest of its component, which is looked up before
    each round: links that are stars already take none. Each round is two joins whose hubs adaptive execution splits,
    and is stored once in the shared folder, the one before deleted; their number grows with the logarithm of the
    largest component. Links of a node to itself and null links are left out.
    """
    spark = links.sparkSession
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    links, path = stored(links.distinct())
    while _unsettled(links):
        before = path
        links, path = stored(_small_star(_large_star(links)))
        delete(spark, before)
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def widened(linked: DataFrame, links: DataFrame) -> DataFrame:
    """``linked``, the components of some links, with more ``links`` (u, v) between the same or other nodes.

    Only the components that the new links join are walked again, each as one node.
    """
    ends = links.select("u", "v")
    for end in ("u", "v"):
        own = linked.select(F.col("node").alias(end), F.col("component").alias("own"))
        ends = ends.join(own, end, "left").withColumn(end, F.coalesce("own", end)).drop("own")
    joined = connected_components(ends)
    over = joined.select(F.col("node").alias("component"), F.col("component").alias("over"))
    moved = linked.join(over, "component", "left").select("node", F.coalesce("over", "component").alias("component"))
    return stored(moved.unionByName(joined.join(linked, "node", "left_anti")))[0]
