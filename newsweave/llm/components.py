"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweave.llm.shared import written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the node's smallest neighbour."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each node of the links (a, b); the component is its smallest id.

    Alternates large and small stars until every node hangs on its smallest one, about
    the logarithm of the longest chain.  Each round is written to the shared folder.
    Links of a node with itself and repeated links change nothing; no links give no rows.
    """
    links = links.where(F.col("a") != F.col("b"))
    links = written(_tidy(_small_star(links)), "links")
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        links = written(_tidy(_small_star(_tidy(_large_star(links)))), "links")
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots).distinct()


def _tidy(links: DataFrame) -> DataFrame:
    return links.where(F.col("a") != F.col("b")).distinct()
