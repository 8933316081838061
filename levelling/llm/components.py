"""Connected components of an edge table, by alternating large and small stars.

Every round each node learns the smallest id among its neighbours (a
map-side-combined minimum, so a hub with most of the edges is no hot group)
and its edges are re-hung there; the rounds end when the edge set no longer
changes, after a number of rounds logarithmic in the component sizes.  Nothing
but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stash


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _least(nb: DataFrame) -> DataFrame:
    return nb.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("k"), F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest id reachable) of all nodes with an edge (``u``, ``v`` long).

    Self loops, repeated edges and either direction may occur; an empty edge
    table gives an empty result.  Nodes that are their own component's
    smallest id are included.
    """
    e = stash(edges.where(F.col("u") != F.col("v"))
              .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_least(both), F.col("u") == F.col("k"))
                 .where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .distinct())
        large = stash(large, "large")
        hung = (large.join(_least(large), F.col("u") == F.col("k"))
                .select("u", "v", "m"))
        small = (hung.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(hung.select("u", F.col("m").alias("v"))).distinct())
        e = stash(small, "small")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
