"""Connected components by distributed union-find: each round unites within partitions, then by large and small stars.

Edges and labels stay in Spark; a hub's edges are spread because stars are joins on an aggregated minimum, which adaptive
execution splits, and not groups held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, staged

_PAIR = "u long, v long"


def _unite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one partition's edges, the smaller id as root; yields (node, root). It flushes its forest at a bound."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root and x != root:
            parent[x] = root
            x = up
        return root

    def forest() -> pd.DataFrame:
        nodes = list(parent)
        return pd.DataFrame({"u": nodes, "v": [find(x) for x in nodes]}, dtype="int64")

    for frame in frames:
        for a, b in zip(frame["u"].tolist(), frame["v"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:
            yield forest()
            parent.clear()
    yield forest()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star (links each larger neighbour to the least one) or small-star (links each smaller one) step."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    both = near.join(least, F.col("u") == F.col("c"))
    if large:
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node that has an edge and isn't itself a root, with the least id it can reach.

    `edges` has long columns u and v; loops, repeated edges, either direction and nulls are allowed, and an empty
    table gives an empty one.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    while True:
        local = staged(edges.mapInPandas(released(_unite), _PAIR), "forest")  # read four times below
        edges = staged(_star(_star(local, large=True), large=False), "components")
        open_ends = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        chained = edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").select(F.col("v").alias("u"))
        if open_ends.unionByName(chained).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
