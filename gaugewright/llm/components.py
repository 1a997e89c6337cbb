"""Connected components of links between numbered things, without collecting links.

Large-star and small-star rounds by turns (Kiveris et al., 2014) until no link changes. Each round is written to the
shared folder, which cuts the lineage; rows per node stay bounded by its links, and are aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller and equal) neighbours to its smallest."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, the root being its component's smallest node; links are columns a, b.

    Self-links and nulls are ignored; repeated links count once; no links give no rows.
    """
    spark = links.sparkSession
    now, path = written(links.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select("a", "b").distinct(), "links")
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).cast("decimal(38,0)"))).first()
        if not mark[0]:
            break
        after, other = written(_star(_star(now, True), False), "links")
        then = after.agg(F.count("*"), F.sum(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).cast("decimal(38,0)"))).first()
        removed(spark, path)
        now, path = after, other
        if tuple(mark) == tuple(then):
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
