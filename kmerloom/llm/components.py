"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.plans.runtime import cut_observed, drop


def _mins(pairs: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, the node itself included."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung under the node's smallest neighbour."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_mins(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung under the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = _mins(down)
    moved = down.join(mins, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(mins.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` -> ``(node, root)`` for every node with a link; root is the smallest node of its component.

    Rows only ever move towards smaller nodes, so a component becomes a star in a logarithmic number
    of rounds in practice; no step gathers a component in one row or task. Self links and repeated links are allowed, nulls are not.
    The table behind the result can be deleted by ``drop``.
    """
    figures = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")
    links, state = cut_observed(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), *figures)
    while state["n"]:
        before, old = links, state
        links, state = cut_observed(_small_star(_large_star(before).where("u <> v").distinct()), *figures)
        drop(before)
        if state == old:
            break
    out = links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())
    out._kmerloom_path = links._kmerloom_path
    return out
