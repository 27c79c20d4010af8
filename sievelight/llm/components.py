"""Connected components of an edge table by alternating large-star and small-star steps.

Every step aggregates on the map side first and joins one row a node. Nodes
with HUB edges and a MOST_HUBS-th of all edges at least are hubs, of which
there can be no more than MOST_HUBS; their rows are broadcast, so that a hub's
edges stay where they are in place of meeting in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm._common import settle

#: Edges from which a node is a hub, at least; no more than this many hubs can be.
HUB, MOST_HUBS = 1000, 200_000


def _with_least(edges: DataFrame, count: int) -> DataFrame:
    """``edges`` with ``m``, the smallest ``lo`` of their ``hi``; ``count`` edges in all, or more."""
    least = edges.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"), F.count("*").alias("n"))
    hub = F.col("n") > max(HUB, count // MOST_HUBS)
    tagged = edges.join(F.broadcast(least.where(hub).select("u", F.col("m").alias("_hub"))), F.col("hi") == F.col("u"), "left").drop("u")
    rest = tagged.where("_hub IS NULL").drop("_hub").join(least.where(~hub).select("u", "m"), F.col("hi") == F.col("u")).drop("u")
    return tagged.where("_hub IS NOT NULL").select("hi", "lo", F.col("_hub").alias("m")).unionByName(rest.select("hi", "lo", "m"))


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0))).first()
    return row[0], row[1]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with an edge, but for roots themselves; a root is its component's smallest node.

    ``edges``: pairs of comparable, non-null values in columns ``a`` and ``b``;
    loops and repeats are allowed. Rounds grow with the square of the
    logarithm of the largest component's size.
    """
    now = settle(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    seen = _fingerprint(now)
    while seen[0]:
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        large = settle(_with_least(both, 2 * seen[0]).where("lo > hi").select(F.col("lo").alias("hi"), F.least("hi", "m").alias("lo")).distinct())
        small = _with_least(large, seen[0]).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = settle(small.union(large.groupBy("hi").agg(F.min("lo").alias("lo"))).distinct())
        mark = _fingerprint(new)
        now, done, seen = new, mark == seen, mark
        if done:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
