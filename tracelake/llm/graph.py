"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step joins the links with the smallest neighbour of each vertex; the links of a vertex with very many of them
stay where they are. Links are written to the shared folder between rounds; only a count comes back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import FEW_KEYS, joined_by_key, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every vertex of links (a, b): component is the smallest id that it reaches."""
    now = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    while True:
        few = 2 * now.count() <= FEW_KEYS  # so there are no more vertices than are broadcast

        def with_least(x: DataFrame) -> DataFrame:
            """x with the smallest v of each u, or u itself."""
            found = x.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n_links")).withColumn("least", F.least("least", "u"))
            return x.join(F.broadcast(found.drop("n_links")), "u") if few else joined_by_key(x, found, "u", "n_links").drop("n_links")  # noqa: B023

        # Large star: every vertex sends its larger neighbours to its smallest.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        # Small star: every vertex sends its smaller neighbours, and itself, to its smallest.
        large = large.filter("u != v")
        small = with_least(large if few else written(large, "links"))
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).union(small.select("u", F.col("least").alias("v")))
        now = written(small.filter("u != v").distinct(), "links")
        # Done when all that is left are stars: no vertex has two links up, and none that others link to has one.
        ends = now.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select(F.col("v").alias("u"), F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
