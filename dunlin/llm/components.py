"""Connected components of a link table by alternating stars: every node learns the smallest node it can reach.

Each round is two grouped minima over the remaining links; links of a hub are replaced by links to the
smallest neighbour, so that long chains halve and hubs never multiply.  Rounds are written to the shared
folder, so that a lost executor costs one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin.llm.common import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: link every greater neighbour to the least of the neighbourhood; small: every not greater one."""
    if large:
        near = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component: for every node of `links` (two integer columns) the smallest node of its component.

    Null ends and loops are no links; an empty table gives an empty table."""
    a, b = links.columns[:2]
    links = materialise(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
                        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        links = materialise(_star(_star(links, True), False), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
