"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum and a join back, so no neighbourhood is ever gathered into one row, and a node with
millions of links is an aggregation Spark combines before the shuffle. The number of rounds grows with log^2 of the
component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: bigint) -> (node, root): every linked node and the smallest node of its component.

    Null ends, self-links and repeated links are ignored; an empty table gives an empty result. Nodes without links
    do not appear.
    """
    spark = links.sparkSession
    edges = store.stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        with store.cleaned(spark):
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, old = now, edges
        edges = store.stash(_small_star(_large_star(edges)), "edges")
        store.drop_stash(old)
