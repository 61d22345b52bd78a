"""Digest trees over ranges: what differs is found, and a part is proved, without looking at the whole.

A tree has a row for each node: the group it belongs to, its level (0: the ranges
themselves), its place in the level and its digest, which is that of its FANOUT children's digests in
order.  Places without a range are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import materialized

FANOUT = 16


def _parents(nodes: DataFrame, keys: list[str], fanout: int) -> DataFrame:
    """The nodes above those of one level; a parent's children are few, so that they meet in one row."""
    children = F.array_sort(F.collect_list(F.struct("position", "digest")))
    up = nodes.groupBy(*keys, (F.col("level") + 1).alias("level"), F.floor(F.col("position") / fanout).cast("long").alias("position"))
    return up.agg(F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ""), 256).alias("digest"))


def tree(leaves: DataFrame, keys: list[str], fanout: int = FANOUT) -> DataFrame:
    """(keys, level int, position, digest): leaves (keys, position, digest) and all nodes above them, up to one root for each group.

    All groups have the height of the largest; each level is written once, and has
    the fanout-th part of the rows of the one below.
    """
    level = materialized(leaves.select(*keys, F.lit(0).alias("level"), F.col("position").cast("long").alias("position"), "digest"))
    highest, out = level.agg(F.max("position")).first()[0], level
    while highest:
        level, highest = materialized(_parents(level, keys, fanout)), highest // fanout
        out = out.unionByName(level)
    return out


def roots(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, digest) of the topmost node of each group."""
    return nodes.groupBy(*keys).agg(F.max_by("digest", "level").alias("digest"))


def differing(ours: DataFrame, theirs: DataFrame, keys: list[str], fanout: int = FANOUT) -> DataFrame:
    """(keys, level, position) of the nodes of two trees that differ or that only one has, from the roots down.

    Of each level only the children of nodes that differ are compared, so that equal parts are never joined.
    """
    top = max((t.agg(F.max("level")).first()[0] or 0) for t in (ours, theirs))
    above, out = None, None
    for level in range(top, -1, -1):
        a, b = ((t.where(F.col("level") == level).select(*keys, "position", F.col("digest").alias(n))) for t, n in ((ours, "one"), (theirs, "two")))
        if above is not None:
            up = above.select(*keys, F.col("position").alias("up"))
            a, b = (t.withColumn("up", F.floor(F.col("position") / fanout).cast("long")).join(up, [*keys, "up"], "left_semi").drop("up") for t in (a, b))
        above = materialized(a.join(b, [*keys, "position"], "full").where(~F.col("one").eqNullSafe(F.col("two"))).select(*keys, F.lit(level).alias("level"), "position"))
        out = above if out is None else out.unionByName(above)
    return out


def proof(nodes: DataFrame, wanted: DataFrame, keys: list[str], fanout: int = FANOUT) -> DataFrame:
    """The nodes that stand beside the way from wanted leaves (keys, position) to the roots: fanout - 1 for each leaf and level at most."""
    top, way, out = nodes.agg(F.max("level")).first()[0] or 0, wanted.select(*keys, "position").distinct(), None
    for level in range(top):
        way = materialized(way)
        up = way.select(*keys, F.floor(F.col("position") / fanout).cast("long").alias("up")).distinct()
        near = nodes.where(F.col("level") == level).withColumn("up", F.floor(F.col("position") / fanout).cast("long"))
        beside = near.join(up, [*keys, "up"], "left_semi").join(way, [*keys, "position"], "left_anti").select(*keys, "level", "position", "digest")
        out = beside if out is None else out.unionByName(beside)
        way = up.withColumnRenamed("up", "position")
    return out if out is not None else nodes.limit(0)


def climbed(leaves: DataFrame, beside: DataFrame, keys: list[str], height: int, fanout: int = FANOUT) -> DataFrame:
    """(keys, digest) of the roots that leaves (keys, position, digest) and their proof() lead to, height levels up: equal to the tree's if the leaves are."""
    way = leaves.select(*keys, F.lit(0).alias("level"), "position", "digest")
    for level in range(height):
        way = _parents(way.unionByName(beside.where(F.col("level") == level)), keys, fanout)
    return way.select(*keys, "digest")
