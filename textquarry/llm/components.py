"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Each step takes minima with partial aggregation, writes them, and joins them back: as a broadcast if their measured size
allows, else as a plain shuffled join, whose hot keys (a node with very many links) adaptive execution splits. Every
round is written to the shared folder, which ends its lineage; the round before it is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.storage import bounded, drop, written


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node of the links ``a, b``; roots are not listed."""
    stars = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        found = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if found == mark:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = found
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = written(least, "least")
        large = both.where("v > u").join(bounded(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "links")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(bounded(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        old, stars = stars, written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop(old, least, large, low)
