"""Connected components over an edge table, by contraction to the smallest neighbour."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u long, v long)`` -> ``(node, root)``: the smallest node that each one reaches.

    Every round maps a node to the smallest of itself and its neighbours and contracts the
    edges. The smallest node of a component always maps to itself, so it ends as the root.
    The rounds' maps are composed from the last to the first. Minima combine on the map side
    and the joins have one row per node on one side, so a node with very many edges is only
    a skewed join, which adaptive execution splits. Nodes without edges have no row. Each round
    is written to the shared folder. Self links count as nodes; null ends are left out.
    """
    maps = []
    edges = written(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u IS NOT NULL AND v IS NOT NULL").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "least")
        maps.append(least)
        ends = edges.join(least, "u").select(F.col("low").alias("a"), F.col("v").alias("u")).join(least, "u").select("a", F.col("low").alias("b"))
        edges = written(ends.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def compose(later: DataFrame, earlier: DataFrame) -> DataFrame:
        later = later.select(F.col("u").alias("low"), F.col("low").alias("end"))
        return earlier.join(later, "low", "left").select("u", F.coalesce("end", "low").alias("low"))

    return reduce(compose, reversed(maps)).select(F.col("u").alias("node"), F.col("low").alias("root"))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` points reaches over the links ``a[i] - b[i]``."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
