"""Connected components of any number of links, by rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for each node of a link; the component is its smallest node.

    Each round replaces the links: a node's larger neighbours are linked to its smallest neighbour
    (large star), then its smaller neighbours and itself are linked to the smallest (small star).
    Both keep what is connected and end with one star a component. A node is met only through
    grouped minima, which are pre-aggregated, and joins, which adaptive execution splits where a
    node has very many links. Each round is a table in the shared folder, so no lineage grows and
    a lost executor costs one round's tasks. Nulls and self-links link nothing. No links: no rows.
    """
    scratch = Scratch(links.sparkSession, "components")
    c = F.col
    edges = scratch.keep(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(c(a).isNotNull() & c(b).isNotNull() & (c("u") != c("v")))
        .distinct()
    )
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where(c("v") > c("u")).select(c("v").alias("u"), c("m").alias("v")).distinct()
        large = scratch.keep(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", c("m").alias("v")), F.struct(c("v").alias("u"), c("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where(c("u") != c("v"))
            .distinct()
        )
        small = scratch.keep(small)
        # in a finished star each node has one link, and no centre is linked to a smaller node
        forked = small.groupBy("u").agg(F.count("*").alias("n")).where(c("n") > 1).select("u")
        chained = small.join(small.select(c("v").alias("centre")), c("u") == c("centre"), "left_semi").select("u")
        more = forked.union(chained).limit(1).count()
        scratch.drop(edges, large)
        edges = small
        if not more:
            break
    centres = edges.select(c("v").alias("node"), c("v").alias("component")).distinct()
    return edges.select(c("u").alias("node"), c("v").alias("component")).union(centres)
