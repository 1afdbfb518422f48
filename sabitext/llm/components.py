"""Connected components by alternating large and small stars; each round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    rest = e.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return rest.union(least.select(F.col("m").alias("a"), "b"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each node of edges (a, b) with a < b that isn't the smallest of its component; root is the smallest."""
    e = written(edges.select("a", "b").where("a < b").distinct(), "edges")
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("b").alias("id"), F.col("a").alias("root"))
        seen = now
        e = written(_small_star(_large_star(e).where("a < b").distinct()).where("a < b").distinct(), "edges")
