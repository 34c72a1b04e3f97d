"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.helpers import attach, checkpointed

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return tuple(r)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of long node ids -> (node, root), root the smallest node
    reachable, for every node with an edge to another.

    Each round replaces edges by edges to smaller nodes; no neighbourhood is
    ever gathered in one task (only its minimum is), and the rounds grow with
    the logarithm of the longest path. Self loops and nulls are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    e = checkpointed(e)
    mark = _mark(e)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = attach(both, low, "a", "n").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpointed(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        seen, mark = mark, _mark(e)
        if mark == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
