"""Multimodality of features and of random projections: the dip from compressed distributions, with p-values.

Every value of every direction is counted on ``LEVELS`` steps between the direction's least and largest value. Counts are added
up inside tasks and merged, so all rows and all directions take part in two passes, and what is shuffled is bounded by the
number of directions. The dip is computed exactly from a direction's counts; moving a value inside its step changes the
distribution by no more than the share of one step, so the dip is within half of the largest step's share of that of the
values (and equal to it where the values are the steps). The null distribution of sqrt(n) * dip comes from uniform hash draws.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.ranks import uniform
from siftlake.operators import space
from siftlake.session import stored

LEVELS = 2048
PROJECTIONS = 60
NULL_DRAWS, NULL_ROWS = 400, 500
SETS = 256  #: data sets whose ranges are broadcast at a time


def _hull(x: np.ndarray, y: np.ndarray, sign: int) -> np.ndarray:
    """Values at x of the greatest convex minorant (sign 1) or least concave majorant (-1) of the points."""
    keep: list[int] = []
    for i in range(len(x)):
        while len(keep) > 1 and sign * ((y[keep[-1]] - y[keep[-2]]) * (x[i] - x[keep[-1]]) - (y[i] - y[keep[-1]]) * (x[keep[-1]] - x[keep[-2]])) >= 0:
            keep.pop()
        keep.append(i)
    return np.interp(x, x[keep], y[keep])


def dip(x: np.ndarray, counts: np.ndarray) -> float:
    """Distance of the distribution with ``counts`` at ascending ``x`` from the nearest unimodal one.

    With the mode at a value, the distribution must be near a convex one before it and a concave one after it, and may jump at
    it. The first distance grows with the mode's place and the second shrinks, so the best mode is found by halving.
    """
    x, counts = np.asarray(x, float)[counts > 0], np.asarray(counts, float)[counts > 0]
    n = len(x)
    if n < 2:
        return 0.0
    upto = np.cumsum(counts) / counts.sum()
    before = np.concatenate([[0.0], upto[:-1]])

    def low(m: int) -> float:
        return float((upto[:m] - _hull(x[: m + 1], before[: m + 1], 1)[:m]).max(initial=0))

    def high(m: int) -> float:
        return float((_hull(x[m:], upto[m:], -1)[1:] - before[m + 1 :]).max(initial=0))

    a, z = 0, n - 1
    while z - a > 1:
        m = (a + z) // 2
        a, z = (m, z) if low(m) < high(m) else (a, m)
    return min(max(low(m), high(m)) for m in (a, z)) / 2


def directions(d: int, projections: int = PROJECTIONS, seed: int = 0) -> np.ndarray:
    """The d features themselves, then unit vectors of Gaussian draws: a column each."""
    v = np.random.default_rng(seed).normal(size=(d, projections))
    return np.concatenate([np.eye(d), v / np.linalg.norm(v, axis=0)], axis=1)


def null_table(spark: SparkSession, draws: int = NULL_DRAWS, rows: int = NULL_ROWS, seed: object = 0) -> np.ndarray:
    """Ascending sqrt(rows) * dip of ``draws`` samples of ``rows`` uniform hash draws."""
    u = spark.range(draws * rows).select((F.col("id") % draws).alias("draw"), uniform(seed, "id").alias("u"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        x, c = np.unique(df["u"].to_numpy(), return_counts=True)
        return pd.DataFrame({"t": [np.sqrt(rows) * dip(x, c)]})

    return np.sort(u.groupBy("draw").applyInPandas(run, "t double").toPandas()["t"].to_numpy())


def dips(rows: DataFrame, features: tuple[str, ...], projections: int = PROJECTIONS, seed: int = 0, levels: int = LEVELS) -> DataFrame:
    """(dataset, direction, n, dip, bound) of standardised rows: directions below the number of features are features, the others
    random projections. ``bound`` is how far the dip may be from that of the values themselves. A constant direction has no dip."""
    spark, names = rows.sparkSession, list(features)
    z = stored(space.standardise(rows.select("dataset", "row_id", *[F.col(f).cast("double").alias(f) for f in names]).dropna(), features).select("dataset", *names), "modal-rows")
    v = directions(len(names), projections, seed)
    sets = sorted(r[0] for r in z.select("dataset").distinct().collect())
    parts = []

    def by_set(b: pa.RecordBatch):
        own = np.array(b.column("dataset").to_pylist(), object)
        x = np.stack([b.column(f).to_numpy(zero_copy_only=False) for f in names], axis=1) @ v
        for name in set(own.tolist()):
            yield name, x[own == name]

    def ranges(batches):
        held: dict = {}
        for b in batches:
            for name, x in by_set(b):
                lo, hi = held.get(name, (np.inf, -np.inf))
                held[name] = np.minimum(lo, x.min(axis=0)), np.maximum(hi, x.max(axis=0))
        for name, (lo, hi) in held.items():
            yield pa.RecordBatch.from_pydict({"dataset": [name] * len(lo), "direction": pa.array(range(len(lo)), pa.int32()), "lo": lo, "hi": hi})

    for i in range(0, len(sets), SETS):
        some = sets[i : i + SETS]
        own = z.where(F.col("dataset").isin(some)) if len(sets) > SETS else z
        found = own.mapInArrow(ranges, "dataset string, direction int, lo double, hi double").groupBy("dataset", "direction").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()
        ends = {name: (g.sort_values("direction")["lo"].to_numpy(), g.sort_values("direction")["hi"].to_numpy()) for name, g in found.groupby("dataset")}
        sent = spark.sparkContext.broadcast(ends)

        def counted(batches, sent=sent):
            held = {}
            for b in batches:
                for name, x in by_set(b):
                    lo, hi = sent.value[name]
                    step = np.clip(((x - lo) / np.where(hi > lo, hi - lo, 1) * (levels - 1)).round().astype(int), 0, levels - 1)
                    if name not in held:
                        held[name] = np.zeros((x.shape[1], levels), np.int64)
                    for k in range(x.shape[1]):
                        held[name][k] += np.bincount(step[:, k], minlength=levels)
            for name, c in held.items():
                k, at = np.nonzero(c)
                yield pa.RecordBatch.from_pydict({"dataset": [name] * len(k), "direction": k.astype(np.int32), "level": at.astype(np.int32), "c": c[k, at]})

        parts.append(own.mapInArrow(counted, "dataset string, direction int, level int, c bigint").groupBy("dataset", "direction", "level").agg(F.sum("c").alias("c")))
    if not parts:
        return spark.createDataFrame([], "dataset string, direction int, n bigint, dip double, bound double")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("level")  # of LEVELS at most
        c = df["c"].to_numpy()
        n = int(c.sum())
        value = dip(df["level"].to_numpy(), c) if len(c) > 1 else np.nan
        return pd.DataFrame({"dataset": [df["dataset"].iloc[0]], "direction": [df["direction"].iloc[0]], "n": [n], "dip": [value], "bound": [c.max() / n / 2]})

    return whole.groupBy("dataset", "direction").applyInPandas(run, "dataset string, direction int, n bigint, dip double, bound double").where("NOT isnan(dip)")


def modality(rows: DataFrame, features: tuple[str, ...], projections: int = PROJECTIONS, seed: int = 0) -> DataFrame:
    """(dataset, mean_dip, dip_share, projected_share, least_p): the features' mean dip, the shares of features and of projections
    whose dip has a p-value below 0.05, and the least p-value of a projection."""
    table = null_table(rows.sparkSession)
    listed = F.array(*[F.lit(float(t)) for t in table])
    d = dips(rows, features, projections, seed)
    p = F.size(F.filter(listed, lambda t: t >= F.sqrt("n") * F.col("dip"))) / len(table)
    d = stored(d.withColumn("p", p).withColumn("own", F.col("direction") < len(features)), "dips")
    low = F.when(F.col("p") < 0.05, 1.0).otherwise(0.0)
    of = lambda c, own: F.when(F.col("own") == own, c)
    return d.groupBy("dataset").agg(F.avg(of(F.col("dip"), True)).alias("mean_dip"), F.avg(of(low, True)).alias("dip_share"), F.avg(of(low, False)).alias("projected_share"), F.min(of(F.col("p"), False)).alias("least_p"))
