"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import shared_dir, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, path: str | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, root): every node of an edge list (a, b) and the smallest node that it reaches, roots left out.

    Each round is written to the shared folder, so plans stay short and lost executors cost one round at
    most. The driver sees one count and one checksum a round. Rounds grow with the logarithm of the
    longest chain; not to converge within most_rounds raises.
    """
    spark = edges.sparkSession
    path = path or shared_dir(spark)
    now, last = written(edges.select("a", "b").filter("a <> b").distinct(), path, "edges0"), None
    for k in range(1, most_rounds + 1):
        now = written(_small_star(_large_star(now)), path, f"edges{k}")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        last = state
    raise RuntimeError(f"components did not converge in {most_rounds} rounds")
