"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stored


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("b", "a"))


def smallest(edges: DataFrame) -> DataFrame:
    """least of each a and its neighbours, as (u, m); u is computed anew so that a later join may split hot nodes."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select((F.col("a") + 0).alias("u"), F.least("a", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b: long), with the smallest node of its component as root.

    Alternating star contraction: every node's larger neighbours are hung on its smallest neighbour, then every node
    and its smaller neighbours on the smallest of them, until nothing changes. Rounds grow with the logarithm of a
    component's diameter; each round's links are written and read back. Links to null, and of a node to itself, count
    for nothing. Without links the result is empty.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = symmetric(edges)
        large = both.where("b > a").join(smallest(both), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        down = smallest(large)
        small = large.join(down, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        edges = stored(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "links")
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == state:
            break
        state = (row["n"], row["h"])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
