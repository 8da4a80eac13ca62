"""Connected components by alternating large and small stars."""

from pyspark.sql import functions as F

from ..session import cut_lineage, release


def _large_star(edges):
    """Every larger neighbour of a node links to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")


def _small_star(edges):
    """A node and its smaller neighbours link to the smallest of them; a < b in edges."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    met = edges.join(least, "b")
    return met.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")) \
        .union(least.select(F.col("m").alias("a"), "b"))


def components(links, a, b):
    """(node, component) for every linked node; component is the smallest node reached.

    Each round halves paths; a node never gathers its neighbours, it only learns their
    minimum, so a node with very many links is an aggregation like any other. Edges are
    checkpointed each round; only a count and a checksum come to the driver.
    """
    edges = links.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")) \
        .where("a < b").distinct()
    edges = cut_lineage(edges)  # every round reads them several times
    before = None
    while True:
        edges = cut_lineage(_small_star(_large_star(edges).distinct()).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        release(edges.sparkSession)  # of the rounds before
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
