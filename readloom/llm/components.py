"""Connected components by alternating star contraction, each round cut by a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(pairs: DataFrame, name: str) -> DataFrame:
    """pairs (u, v) with m, the least v of each u. The minima are written first, so that both sides of the join are
    exchanges of their own and AQE can split the rows of a hub."""
    least = common.written(pairs.groupBy("u").agg(F.min("v").alias("m")), name)
    return pairs.join(least, "u")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node reachable. Loops (a = b) and repeats are fine;
    links with a null end are none."""
    edges = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = common.written(edges, "components-links")
    before = _signature(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        # large star: every larger neighbour of u moves to the least of u and its neighbours
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _with_least(both, "components-least").filter("v > u").select(F.least("u", "m").alias("a"), F.col("v").alias("b"))
        large = common.written(large.distinct(), "components-large")
        # small star: u and its smaller neighbours move to the least of them
        down = _with_least(large.select(F.col("b").alias("u"), F.col("a").alias("v")), "components-least")
        ends = F.explode(F.array("u", "v"))
        edges = common.written(down.select(F.col("m").alias("a"), ends.alias("b")).filter("a <> b").distinct(), "components-small")
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("component")))
