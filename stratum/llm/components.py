"""Connected components of a table of links, by alternating star contraction in the shared folder.

Each round makes every node's larger neighbours point to its smallest one (large star), then its smaller ones
(small star); rows never outnumber the links by more than a constant, and no group is gathered: neighbours are
reduced by min(), which Spark combines before it shuffles. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import cut, drop_cut


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with a < b. One large- or small-star step; the result is again (a, b) with a < b, distinct."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:  # every larger neighbour of a points to the smallest of a's closed neighbourhood
        out = joined.where("b > a").select(F.col("m").alias("a"), "b")
    else:  # here b < a: a and its smaller neighbours point to the smallest
        out = joined.select(F.col("m").alias("a"), "b").unionAll(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return out.where("a < b").distinct()


def components(edges: DataFrame, name: str = "components", roots: bool = True) -> DataFrame:
    """(node, component): the smallest node of each connected component, for the nodes that have a link to another node; without roots, for those of them that aren't that smallest node. edges: columns a, b (longs)."""
    now, written = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), None
    while True:
        now = cut(star(star(now, True), False), name)
        if written is not None:
            drop_cut(written)
        written = now
        # done when every node is either a root or points to one root only
        sides = now.select(F.col("b").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(now.select(F.col("a").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = sides.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1")
        if not open_.agg(F.count("*")).first()[0]:
            break
    out = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return out.unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()) if roots else out
