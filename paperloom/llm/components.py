"""Connected components of a link table, by alternating large-star and small-star steps.

Each half step joins links with the smallest neighbour of a node; the smallest neighbours are written
before they are joined, so that both sides are dealt anew and a node with very many links is split.
Links of a large star are not made distinct: they are as many as before, and the small star does it.
Only whether a node is left to join reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.scratch import discard, written


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v"), F.col("u")))


def _large_star(links: DataFrame, least: DataFrame) -> DataFrame:
    """The larger neighbours of every node, linked to the least of it and its neighbours; not distinct, as many as links."""
    joined = _both(links).filter("v > u").join(least.select("u", F.least("u", "m").alias("m")), "u")
    return written(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v"), "star-large")


def _small_star(links: DataFrame) -> DataFrame:
    """The smaller neighbours of every node, and the node, linked to the least of them; distinct."""
    least = written(links.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    joined = links.join(least, "u")
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    out = written(out.filter("u != v").distinct(), "star-small")
    discard(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (u, v); component is its smallest node. Nodes without a
    link are absent. Null ends are ignored."""
    now = written(links.filter("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star-links")
    while True:
        least = written(_both(now).groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "star-least")
        # Done when every node with a smaller neighbour has no other one: then every component is a star.
        if least.filter("m < u and n > 1").isEmpty():
            break
        large = _large_star(now, least)
        discard(least, now)
        now = _small_star(large)
        discard(large)
    discard(least)
    # At the end every link is from a node to the smallest node of its component.
    found = written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct()), "components")
    discard(now)
    return found
