"""Connected components of a link table, by alternating large-star and small-star steps.

Each step sends every node's neighbours to the smallest one nearby, as a partial aggregate and an equi-join; after about log(n) rounds every component is
a star around its smallest node; a round's table replaces the one before. A node with very many links is only ever the skewed side of a join whose other side has one row per node, which
adaptive execution splits. Nothing is collected but the two sums that tell whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import replaced, staged


def smallest(links: DataFrame) -> DataFrame:
    """(node, low): the smallest of each node and its neighbours v, from (u, v) rows."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("low"))


def large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = both.filter("v > u").join(smallest(both), F.col("u") == F.col("node"))
    return moved.select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = smallest(down)
    moved = down.join(low, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.select(F.col("node").alias("u"), F.col("low").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v), roots included; root is the smallest node of the component.

    Null ends and self-links are dropped; repeated links count once."""
    now = staged(links.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not row[0] or tuple(row) == state:
            break
        state = tuple(row)
        now = replaced(small_star(large_star(now)), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
