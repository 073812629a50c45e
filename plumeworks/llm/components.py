"""Connected components of a graph given as rows of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A node with more links than this, and than one in 50,000 of all, is a hub: there are 100,000 hubs at most.
HUB = 20_000


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def with_least(rows: DataFrame, least: DataFrame, node: str, links: int) -> DataFrame:
    """Rows with what `least` has of their node: its columns but `degree`, the rows of the node.

    links: the rows in all. Hubs' rows stay where they are, as the hubs are few enough to
    be sent to each task; the others are dealt by node, none of which has many. How many these
    are grows with the input, so they are never sent through the driver, whatever Spark's threshold.
    """
    kept = [F.col(c) for c in least.columns if c not in (node, "degree")]
    dealt = lambda rows, least: rows.join(least.drop("degree").hint("merge"), node).select(*rows.columns, *kept)
    if links <= HUB:  # there can't be a hub
        return dealt(rows, least)
    most = max(HUB, links // 50_000)
    least = stored(least, "least")
    hubs = least.where(f"degree > {most}").drop("degree")
    if hubs.isEmpty():
        return dealt(rows, least)
    at_hubs = rows.join(F.broadcast(hubs), node).select(*rows.columns, *kept)
    return at_hubs.unionByName(dealt(rows.join(F.broadcast(hubs.select(node)), node, "left_anti"), least.where(f"degree <= {most}")))


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) of every node that a link (a, b) names; a component is its smallest node.

    Large-star and small-star steps by turns: each hangs a node's neighbours on
    the least of them, until nothing changes. Minima are combined before they are
    shuffled, and the neighbours of a hub are not dealt to one task.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = stored(links, "links")
    before = _sum(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
        large = with_least(both, least, "u", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large") if 2 * before[0] > HUB else large
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = with_least(large, least, "u", 2 * before[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = _sum(links)
        if after == before:
            break
        before = after
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
