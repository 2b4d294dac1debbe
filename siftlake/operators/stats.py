"""Tests and intervals over paired results, one value for each data set (hundreds of rows, never points)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions.ranks import average_rank, draw_order, places, uniform
from siftlake.session import stored

UNITS = 500_000  #: keys that are sent to all tasks of a bootstrap; more are joined by shuffles


def wilcoxon_sums(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, w, z): signed ranks of the differences without zeros, and the tie-corrected normal score of the smaller sum."""
    d = df.withColumn("_d", F.round(F.col(a) - F.col(b), 12)).where("_d <> 0").withColumn("_a", F.abs("_d"))
    d = d.withColumn("_r", average_rank(by, "_a")).withColumn("_t", F.count(F.lit(1)).over(W.partitionBy(*by, "_a")))
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("down"), F.sum(F.col("_t") * F.col("_t") - 1).alias("ties"))
    g = g.withColumn("w", F.least("up", "down"))
    return g.select(*by, "n", "w", F.expr("(w - n * (n + 1) / 4.0D) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0D - ties / 48.0D)").alias("z"))


def wilcoxon(df: DataFrame, by: list[str], a: str, b: str, exact: int = 25) -> DataFrame:
    """(by, n, w, p): two-sided; exact by counting sign patterns for up to ``exact`` pairs without ties, else normal."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.round(pdf[a].to_numpy(float) - pdf[b].to_numpy(float), 12)
        d = d[d != 0]
        n, size = len(d), np.abs(d)
        rank = pd.Series(size).rank().to_numpy()
        w = float(min(rank[d > 0].sum(), rank[d < 0].sum()))
        if n == 0:
            p = 1.0
        elif n <= exact and len(set(size)) == n:
            ways = np.zeros(n * (n + 1) // 2 + 1)
            ways[0] = 1
            for r in range(1, n + 1):
                ways[r:] = ways[r:] + ways[:-r]
            p = min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n)
        else:
            _, t = np.unique(size, return_counts=True)
            var = n * (n + 1) * (2 * n + 1) / 24 - (t**3 - t).sum() / 48
            p = math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(max(var, 1e-12)) / math.sqrt(2))
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in by} | {"n": [n], "w": [w], "p": [p]})

    return df.groupBy(*by).applyInPandas(run, f"{kinds}, n long, w double, p double")


def holm(df: DataFrame, by: list[str], key: str, p: str) -> DataFrame:
    """df with p_holm: (m - i) * p in ascending order of p, and p_holm_monotone with the running maximum, both at most 1."""
    w = W.partitionBy(*by)
    order = w.orderBy(p, key)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(w) - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("p_holm", step).withColumn("p_holm_monotone", F.max("p_holm").over(order.rowsBetween(W.unboundedPreceding, 0)))


def bootstrap_mean(df: DataFrame, by: list[str], value: str, key: str, draws: int = 10_000, seed: object = 0) -> DataFrame:
    """(by, mean, low, high): 95 % percentile interval of the mean when the keys, each with all its rows, are drawn again.

    A draw is a hash: for each key there is one pick, at the place floor(u * n) of the unit's keys in order, with u from the MD5
    of seed, draw and key, so any SQL engine draws the same. Draws and keys are rows of a join, added up by draw inside tasks:
    the keys are sent to the picks, which are dealt over all tasks. The planner sizes picks like keys, so the join is told which.
    """
    units = df.groupBy(*by, key).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    w = W.partitionBy(*by)  # a row for each key
    units = units.withColumn("_at", F.row_number().over(w.orderBy(key)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    units = stored(units, "units")
    dealt = units.select(*by, "_n", key).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, key)
    picks = dealt.select(*by, "_n", key, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_d"))
    picks = picks.select(*by, "_d", F.floor(uniform(seed, "_d", key) * F.col("_n")).cast("int").alias("_at"))
    picked, how = units.select(*by, "_at", "_s", "_c"), "broadcast" if units.count() <= UNITS else "merge"
    means = picks.join(picked.hint(how), [*by, "_at"]).groupBy(*by, "_d").agg(F.try_divide(F.sum("_s"), F.sum("_c")).alias("_m"))
    cuts = means.groupBy(*by).agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high"))
    return units.groupBy(*by).agg(F.try_divide(F.sum("_s"), F.sum("_c")).alias("mean")).join(cuts, by)


def sign_flip(df: DataFrame, by: list[str], value: str, cluster: str, draws: int = 20_000, seed: object = 0) -> DataFrame:
    """(by, mean, p): (1 + draws at least as far from zero) / (draws + 1) when whole clusters change sign at random.

    A cluster's sign in a draw is a bit of the MD5 of seed, draw and cluster.
    """
    units = stored(df.groupBy(*by, cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_c")), "units")
    signs = units.select(*by, "_s", cluster, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_d"))
    signed = F.when(uniform(seed, "_d", cluster) < 0.5, F.col("_s")).otherwise(-F.col("_s"))
    totals = signs.groupBy(*by, "_d").agg(F.abs(F.sum(signed)).alias("_t"))
    seen = units.groupBy(*by).agg(F.sum("_s").alias("_all"), F.sum("_c").alias("_c"))
    hits = totals.join(seen, by).groupBy(*by).agg(F.count(F.when(F.col("_t") >= F.abs("_all") - 1e-9, 1)).alias("_h"))
    return seen.join(hits, by).select(*by, F.try_divide("_all", "_c").alias("mean"), ((F.col("_h") + 1) / (draws + 1)).alias("p"))


def paired_effect(df: DataFrame, by: list[str], a: str, b: str, tie: float = 1e-9) -> DataFrame:
    """(by, dz, wins, ties, losses) of a against b; fewer is better for neither: wins are a > b."""
    d = df.withColumn("_d", F.col(a) - F.col(b))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return d.groupBy(*by).agg(F.try_divide(F.avg("_d"), F.stddev_samp("_d")).alias("dz"), count(F.col("_d") > tie).alias("wins"), count(F.abs("_d") <= tie).alias("ties"), count(F.col("_d") < -tie).alias("losses"))


def leave_one_out(df: DataFrame, key: str, value: str) -> DataFrame:
    """(left_out, mean): the mean without each key in turn, from sums by key rather than a join of rows with keys."""
    g = df.groupBy(key).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    w = W.partitionBy()  # a row for each key
    return g.select(F.col(key).alias("left_out"), F.try_divide(F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n")).alias("mean"))


def scrambled(pseudo: DataFrame, keys: list[str], value: str, seed: object) -> DataFrame:
    """The keys with their values permuted: row order against MD5 order, joined by place.

    Places come from ranges: each partition numbers its own rows and adds the counts before it.
    """
    named = pseudo.select(*keys, value)
    left = places(named.select(*keys), list(keys), "_k")
    right = places(named.withColumn("_d", draw_order(seed, *keys)).select(value, "_d"), ["_d"], "_k").select(value, "_k")
    return left.join(right, "_k").drop("_k")


def drop_one(pool: DataFrame, key: str) -> DataFrame:
    """The rows once for each key left out, without that key's own."""
    names = pool.select(F.col(key).alias("left_out")).distinct()  # a pool of tens
    return pool.crossJoin(F.broadcast(names)).where(F.col(key) != F.col("left_out"))


def gap_closed(df: DataFrame, by: list[str], regret: str, fixed: str) -> DataFrame:
    """(by, gap): 1 - mean regret / mean regret of the fixed pick."""
    return df.groupBy(*by).agg((1 - F.try_divide(F.avg(regret), F.avg(fixed))).alias("gap"))
