"""Connected components of a link table by rounds of contraction, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclelens.llm.common import in_few_tasks, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): two nodes are connected exactly if they have one root.

    In each round every node points to its least neighbour, or itself, and the links between the targets remain. Even rounds take the
    least id, which ends stars at once; odd rounds take a random order, which shortens chains by half on average, so that the number of
    rounds grows with the logarithm of the longest chain. A round moves each remaining link twice and keeps nothing in the driver.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots, turn = None, 0
    while n := edges.count():
        rank = (lambda c, t=turn: F.xxhash64(F.lit(t), c)) if turn % 2 else (lambda c: c)
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b").alias("v"))).alias("least"))
        to = F.when(F.col("least.r") < rank(F.col("a")), F.col("least.v")).otherwise(F.col("a"))
        step = written(in_few_tasks(least.select(F.col("a").alias("v"), to.alias("to")), 2 * n), "component-step")
        moved = edges.join(step, edges["a"] == step["v"]).select(F.col("to").alias("a"), "b")
        moved = moved.join(step, moved["b"] == step["v"]).select("a", F.col("to").alias("b")).where("a <> b")
        edges = written(in_few_tasks(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n), "links")
        if roots is None:
            roots = step.select(F.col("v").alias("node"), F.col("to").alias("root"))
        else:
            roots = written(roots.join(step, roots["root"] == step["v"], "left").select("node", F.coalesce("to", "root").alias("root")), "component-roots")
        turn += 1
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
