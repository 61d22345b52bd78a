"""Connected components of a link table by alternating stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the least of u's neighbourhood."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """With u > v in every link: u and its neighbours are linked to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    kept = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u long, v long) -> (u, root): each linked vertex with the smallest vertex of its component.

    Links may be in either direction, repeated or loops; vertices without a
    link to another have no row.  Each round is two grouped minima and joins
    (map-side combined, so a vertex with many links makes no heavy group), and
    the number of rounds grows with the logarithm of the longest path.  An
    empty table gives an empty one.
    """
    links = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == state:
            return links.select("u", F.col("v").alias("root")).union(links.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        state = now
        links = written(_small_star(_large_star(links)), "stars")
