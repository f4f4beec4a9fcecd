"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemetrics.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of a link ``a``-``b``; the component is its smallest node.

    Each round hangs every node on the smallest node it can see, first with its larger neighbours,
    then with its smaller ones, until the links are stars. Rounds grow with the logarithm of the
    longest chain. All steps are joins and map-side combined minima, so no component is gathered.
    """
    edges = stored(_downward(links.select("a", "b")))
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        edges = stored(_small_star(_large_star(edges)))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _downward(edges: DataFrame) -> DataFrame:
    """Distinct links from the larger node to the smaller one."""
    pair = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return pair.distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return _downward(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _downward(hung.unionByName(least.select("a", F.col("m").alias("b"))))
