"""Problem 5: consolidating pairwise matches into groups by hash-to-min."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import discard, materialize


def hash_to_min(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(vertex, group_min)`` of every vertex of the undirected graph of ``pairs``; the group's name is its least vertex.

    Every vertex v holds a cluster C(v), at first itself and its neighbours. In each round it sends C(v) to the minimum of C(v) and that
    minimum to all members, until nothing changes (O(log n) rounds in practice). Clusters are kept as rows (v, member), never as
    arrays; the minimum is combined map-side. Minima and rounds are written to the shared folder: that cuts the lineage, and since both sides of the
    join are then read through a shuffle, AQE splits the rows of a vertex with a large cluster over tasks. Tables no longer needed are deleted; the result is a
    written table too.
    Pairs with a null end and self-pairs join nothing and give no vertex; repeated and reversed pairs count once.
    """
    edges = pairs.select(F.col(a).alias("v"), F.col(b).alias("u")).filter("v IS NOT NULL AND u IS NOT NULL AND v <> u")
    both = F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")), F.struct("v", F.col("v").alias("u")), F.struct(F.col("u").alias("v"), "u")))
    state = materialize(edges.select(both.alias("e")).select("e.v", "e.u").distinct(), "clusters")
    before = None
    while True:
        # two sums of hashes and the count tell whether a round changed the rows
        mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if mark == before:
            break
        before = mark
        least = materialize(state.groupBy("v").agg(F.min("u").alias("m")), "minima")
        sent = F.explode(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))))
        after = materialize(state.join(least, "v").select(sent.alias("e")).select("e.v", "e.u").distinct(), "clusters")
        discard(state)
        discard(least)
        state = after
    out = materialize(state.groupBy(F.col("v").alias("vertex")).agg(F.min("u").alias("group_min")), "groups")
    discard(state)
    return out
