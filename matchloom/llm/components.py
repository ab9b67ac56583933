"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, with_each


def _hang(edges: DataFrame, larger: bool, total: int) -> DataFrame:
    """One star step: hang neighbours under the least node of each neighbourhood.

    ``larger``: the larger neighbours of every node, else the smaller ones and the node itself.
    The neighbourhood of a centre may hold most edges, so its rows are not gathered.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = staged(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many")).select("u", F.least("u", "m").alias("m"), "many"), "least")
    joined = with_each(both, least, "u", total)
    if larger:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return staged(out.where("u <> v").distinct(), "edges")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for the nodes of the edges ``(u, v)``; the component is its least node, which has no row.

    Large-star and small-star steps alternate until nothing changes (a number of rounds
    that grows with the logarithm of the graph); each step is written out, so the
    plan stays short and lost executors cost one step. No component is collected.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark, total = None, now.count()
    for _ in range(rounds):
        now = _hang(_hang(now, True, total), False, total)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark, total = seen, seen[0]
    raise RuntimeError(f"no end after {rounds} rounds")
