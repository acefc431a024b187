"""Connected components of a table of links, by alternating large and small stars.

No node's neighbours are gathered: each star is a minimum per node and a join of the links with it, both of which
Spark splits when a node has many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.session import pin


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point each node's greater (large) or lesser (small) neighbours to the least node around it."""
    around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # here u > v: u itself and its lesser neighbours go to the least of them
    moved = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, name: str) -> DataFrame:
    """``(u, v)``: each node with a link to a lesser one, and the least node of its component.

    ``links`` has long columns ``u`` and ``v``; direction, repeats and loops don't matter, rows with a null are no links.
    The least node of a component has no row. Rounds grow with the logarithm of the longest path.
    """
    links = pin(
        links.dropna().filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        f"{name}-links",
    )
    before = None
    while True:
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return links
        before = now
        links = pin(_star(_star(links, large=True), large=False), f"{name}-stars")
