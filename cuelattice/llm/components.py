"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelattice.llm.common import Scratch, in_few
from cuelattice.plans.session import written


def _star(edges: DataFrame, large: bool, put: Callable[[DataFrame], DataFrame], rows: int) -> DataFrame:
    """One round over (u, v) rows, of which there are ``rows`` at most: each node's neighbours are tied to the smallest of them and the node.

    The minima are aggregated before the shuffle, written out and joined back: the join then has plain exchanges below it,
    which the planner can split where a node has very many neighbours.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = put(in_few(both.groupBy("u").agg(F.min("v").alias("m")), 2 * rows).select(F.col("u").alias("at"), F.least("u", "m").alias("m")))
    tied = in_few(both.join(least, F.col("u") == F.col("at")), 2 * rows)
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("at").alias("u"), F.col("m").alias("v")))
    return put(in_few(out.filter("u <> v").distinct(), 2 * rows))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node reachable.

    Null ends and loops are ignored, repeated edges count once; no edges give no rows. Each round is written to the
    checkpoint folder. The number of rounds grows with the logarithm of the longest path.
    """
    digest = lambda e: tuple(e.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    with Scratch(edges.sparkSession) as scratch:
        now = scratch.put(edges.filter("u <> v").select("u", "v").distinct())
        before = digest(now)
        for _ in range(most_rounds if before[0] else 0):
            now = _star(_star(now, True, scratch.put, before[0]), False, scratch.put, before[0])
            scratch.keep_only()
            after = digest(now)
            if after == before:
                break
            before = after
        else:
            if before[0]:
                raise RuntimeError("components did not settle")
        both = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")))
        return written(in_few(both.distinct(), 2 * before[0]))
