"""Connected components of a table of links, by alternating large-star and small-star steps.

The steps follow "Connected Components in MapReduce and Beyond" (Kiveris et al., 2014). Each step sums
the smallest neighbour of a node before the shuffle, writes it, and joins two scans, so that the rows
of a node with very many links can be split. Links never reach the driver, only two sums do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


#: Links to a file: a graph has far fewer rows than the table it comes from.
PER_FILE = 100_000


def _star(links: DataFrame, large: bool, files: int) -> DataFrame:
    """links (a, b) with a < b; the same components, drawn closer to their smallest node."""
    if large:
        sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = sides.join(written(least, "least", files), "a").where("b > a")
        out = joined.select(F.col("m").alias("a"), "b")
    else:
        sides = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = sides.groupBy("u").agg(F.min("v").alias("m"))
        joined = sides.join(written(least, "least", files), "u")
        out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(joined.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return written(out.where("a < b").distinct(), "links", files)


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node it reaches."""
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links", files)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, was = state(links), None
    while now != was and now[0]:
        files = -(-now[0] // PER_FILE)
        links = _star(_star(links, True, files), False, files)
        was, now = now, state(links)
    roots = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
