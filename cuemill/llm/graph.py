"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import discard, staged


def _large_star(links: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest node it knows."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the smallest of them (links point from larger to smaller)."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    rest = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long, u <> v); root is the component's smallest node.

    Rounds of large and small stars until nothing changes, about log n squared of
    them at worst.  Every step is a grouped minimum (combined before the shuffle)
    and a join on the node, so a hub's links are never gathered; each round is
    written to the shared folder.
    """
    now = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        # the state is the set of links; its size and a sum of hashes tell whether it changed
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark or not row["n"]:
            # each node points at its root; the roots point at themselves
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark, old = (row["n"], row["h"]), now
        now = staged(_small_star(_large_star(old).where("u > v").distinct()).distinct(), "links")
        discard(old)
