"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, written


def components(links: DataFrame, keep: Scratch | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id reachable) of every id that has a link to another one, as a written table (one of keep's, if given).

    Each round lets every id tell its larger neighbours, then its smaller ones, of the least neighbour it knows, until
    nothing changes: all ids then point to their component's least. The number of rounds grows as the logarithm of
    the longest chain. Every round is a written table, deleted after the next. Nulls and self-links are ignored.
    """
    with Scratch(links.sparkSession) as scratch:
        edges = scratch.write(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b)).distinct())
        before = None
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
            last, edges = edges, scratch.write(small)
            scratch.drop(last)
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == before:
                tops = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
                return (keep.write if keep else written)(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(tops))
            before = now
