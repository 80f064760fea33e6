"""Connected components by alternating large and small stars, in DataFrame operations.

Each round hangs every node on the least neighbour it knows; stars come after a number of
rounds that grows with the logarithm of the longest path. Rounds are written to the shared
folder; hubs with many neighbours are handled by partial aggregation and skew joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.runtime import discard, settle


def _hang(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return _hang(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _hang(moved.unionByName(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that isn't the least of its component, and the least. Edges are (u, v) of bigint."""
    now, mark = settle(_hang(edges), "edges"), None
    while True:
        after = settle(_small(_large(now)), "edges")
        seen = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discard(now)
        now = after
        if seen == mark:
            return now
        mark = seen
