"""Connected components of a table of links, by alternating large and small stars; every step is an aggregate and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _settled(edges: DataFrame) -> tuple:
    # Ids may be any longs, whose sum doesn't fit a long.
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.col("lo").cast("decimal(28,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``links`` (a, b): root is the smallest vertex that links reach from v.

    Rounds grow with the logarithm of the longest chain. Each writes its edges and its minima, so that joins on a hub
    that holds a large share of the edges are plain joins of two tables, which adaptive execution can split. Loops,
    repeated links and both directions of a link are allowed; links with a null end are ignored; no links give no rows.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.filter(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges = materialize(edges, "edges")
    alone = edges.filter("hi = lo").select(F.col("hi").alias("v"), F.col("lo").alias("root"))
    edges = edges.filter("hi > lo")
    before = None
    while (now := _settled(edges)) != before:
        before = now
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialize(large.distinct(), "large-star")
        least = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi > lo")
        edges = materialize(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
    rooted = edges.select(F.col("hi").alias("v"), F.col("lo").alias("root"))
    roots = edges.select(F.col("lo").alias("v"), F.col("lo").alias("root"))
    return rooted.unionByName(roots).unionByName(alone).distinct()
