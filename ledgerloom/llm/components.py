"""Connected components of rows that share keys, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import settle


def star_edges(links: DataFrame, node: str, key: str) -> DataFrame:
    """Edges (u, v), u > v: every node of a key to the key's smallest node.

    A key with n nodes gives n - 1 edges, never all pairs; its minimum is taken
    with map-side combining, so a hot key is one row per task before the shuffle.
    """
    pairs = links.select(F.col(node).alias("u"), F.col(key).alias("k")).where("u is not null and k is not null").distinct()
    least = pairs.groupBy("k").agg(F.min("u").alias("v"))
    return pairs.join(least, "k").where("u <> v").select("u", "v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def component_labels(edges: DataFrame) -> DataFrame:
    """(u, v) for every node that is not its component's smallest: v is that one.

    The result is a fixed point of both star steps, reached in O(log² n) rounds;
    every round is cut off with a written table.
    """
    now = settle(edges)
    before = _state(now)
    while before[0]:
        now = settle(_small_star(_large_star(now)), instead_of=now)
        after = _state(now)
        if after == before:
            break
        before = after
    return now
