"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.session import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50) -> DataFrame:
    """(node, component) for each node with a link; the component is its smallest node.

    Each round links every node's larger neighbours to its smallest neighbour
    (large star), then its smaller neighbours likewise (small star), until
    nothing changes; the rounds grow with the logarithm of the longest path.
    Rows are written to the shared folder between rounds; nothing but a count
    and a checksum comes to the driver.  Null ends and self-links are dropped.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def both_ways(e: DataFrame) -> DataFrame:
        return e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def large_star(e: DataFrame) -> DataFrame:
        near = both_ways(e)
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        linked = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        return linked.unionAll(least.select("u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = cut(edges)
    before = mark(edges)
    for _ in range(most_rounds):
        edges = cut(small_star(large_star(edges)))
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
