"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame, functions as F

from cargoframe.sources.scratch import settle


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's least neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from every node that has an edge (u, v).

    The minimum of a neighbourhood is aggregated and joined back, so a node with any number of
    neighbours is never gathered. Only a count and a checksum of a round reach the driver.
    """
    edges = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .filter("u <> v").distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        edges = settle(_small(_large(edges)), "edges")
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
