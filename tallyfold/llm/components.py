"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table

ROUNDS = 60


def _least(edges: DataFrame, least) -> DataFrame:
    """The least neighbour of each u as (k, m). The key is computed, so that a join on it deals both sides anew and
    adaptive execution can split a hub with very many edges."""
    return edges.groupBy("u").agg(least.alias("m")).select(F.bitwise_not(F.bitwise_not("u")).alias("k"), "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs: one row (node, root) per node, root the least node of its component.

    Each round takes minima by node (combined before the shuffle) and joins them back, and is written to the shared
    folder; the rounds end when every node hangs on a root and on nothing else. Loops (a = b) keep their node; an empty
    table gives none.
    """
    now = kept_table(edges.select("a", "b").distinct(), "edges")
    for _ in range(ROUNDS):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        least = _least(both, F.least(F.min("v"), F.first("u")))
        large = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        loops = now.where(F.col("a") == F.col("b")).select(F.col("a").alias("u"), F.col("b").alias("v"))
        large = large.union(loops).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = _least(down, F.min("v"))
        small = down.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()
        now = kept_table(small, "edges")
        hung = now.where(F.col("a") != F.col("b"))
        places = hung.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        places = places.union(hung.select(F.col("b"), F.lit(0), F.lit(1)))
        wrong = places.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        if wrong.isEmpty():
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
