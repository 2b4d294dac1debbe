"""Ranks, deterministic draws and running totals that the other operators share.

Missing is always NULL: NaN is turned into NULL where data comes in. Every pick has an explicit tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.session import stored


def average_rank(by: list[str], value: str, descending: bool = False) -> Column:
    """Rank from 1 within ``by``; ties share the mean of their ranks."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    ties = F.count(F.lit(1)).over(W.partitionBy(*by, value))
    return F.rank().over(W.partitionBy(*by).orderBy(order)) + (ties - 1) / 2.0


def draw_order(seed: object, *keys: str) -> Column:
    """A reproducible shuffle: MD5 of seed and keys, the same in any SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def uniform(seed: object, *keys: str) -> Column:
    """A reproducible draw in [0, 1): the first 8 hex digits of an MD5."""
    return F.conv(F.substring(draw_order(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def z_score(by: list[str], value: str, epsilon: float = 0.0) -> Column:
    """Population z-score within ``by``; NULL where the deviation is zero, unless ``epsilon`` is added to it."""
    w = W.partitionBy(*by)
    sd = F.stddev_pop(value).over(w) + F.lit(epsilon)
    return F.try_divide(F.col(value) - F.avg(value).over(w), sd)


def min_max(by: list[str], value: Column, otherwise: float = 0.5) -> Column:
    """Scaled to [0, 1] within ``by``; ``otherwise`` where all are equal."""
    w = W.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi - lo < 1e-12, F.lit(otherwise)).otherwise((value - lo) / (hi - lo))


def first_by(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group, with ties broken by the order given."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def running_totals(df: DataFrame, by: list[str], order: str, sums: list[str], splits: int | None = None) -> DataFrame:
    """Inclusive running sums ``cum_<name>`` and group totals ``all_<name>``, in descending ``order`` within ``by``.

    With ``splits``, a group of any size is dealt by ranges of ``order`` into that many partitions: each task sums its own
    range, and the ranges' totals (splits rows for each group) are added as offsets. Without, a group is one task's work.
    """
    if splits is None:
        run = W.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
        return df.select("*", *[F.sum(s).over(run).alias(f"cum_{s}") for s in sums], *[F.sum(s).over(W.partitionBy(*by)).alias(f"all_{s}") for s in sums])
    # the ranges are used twice and must be the same both times
    dealt = stored(df.repartitionByRange(splits, *by, F.col(order).desc()).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = W.partitionBy(*by, "_part").orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy(*by, "_part").agg(*[F.sum(s).alias(f"_p_{s}") for s in sums])
    zero = F.lit(0)
    parts = parts.select(*by, "_part", *[F.coalesce(F.sum(f"_p_{s}").over(before), zero).alias(f"_o_{s}") for s in sums], *[F.sum(f"_p_{s}").over(W.partitionBy(*by)).alias(f"all_{s}") for s in sums])
    out = dealt.select("*", *[F.sum(s).over(inside).alias(f"_i_{s}") for s in sums]).join(parts, [*by, "_part"])
    return out.select(*df.columns, *[(F.col(f"_i_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums], *[f"all_{s}" for s in sums])


def places(df: DataFrame, order: list[Column | str], name: str, splits: int = 64) -> DataFrame:
    """df with ``name``: each row's place from 1 in the order of all rows, which must be without ties.

    Rows are dealt by ranges of the order; each range numbers its own rows and adds the counts of the ranges before it.
    """
    dealt = stored(df.repartitionByRange(splits, *order).withColumn("_part", F.spark_partition_id()), "places")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    offsets = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, own + F.col("_o")).drop("_part", "_o")
