"""Windowing and features of series (series, pos, value, label); order is always explicit."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.functions.ranks import average_rank

WIDTH, STRIDE = 64, 16
STRETCH = 1 << 14  #: points of a series that one task takes for frames
SMOOTHING, SPREADS, OFFSETS = (8, 32, 128, 512), (0, 1), (0, 1, 3)


_SPECTRAL = T.StructType([T.StructField(n, T.IntegerType() if n == "peak" else T.DoubleType()) for n in ("entropy", "crest", "peak", "b1", "b2", "b3", "b4")])


def sliding(series: DataFrame, width: int = WIDTH, stride: int = STRIDE, min_count: int = 1) -> DataFrame:
    """(series, win, pos, v, y): whole windows at every ``stride``, their values in order, and 1 if ``min_count`` points in it are
    labelled.

    A point belongs to at most ceil(width / stride) windows, so it is dealt to those and windows are grouped: a series of
    any length is spread over all tasks, which a frame over the series would not be.
    """
    k = -(-width // stride)
    wins = F.expr(f"filter(transform(sequence(0, {k - 1}), i -> floor(pos / {stride}) - i), w -> w >= 0 AND pos < w * {stride} + {width})")
    dealt = series.select("series", "pos", "value", "label", F.explode(wins).alias("win"))
    g = dealt.groupBy("series", "win").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("p"), (F.sum("label") >= min_count).cast("int").alias("y"))
    return g.where(F.size("p") == width).select("series", "win", (F.col("win") * stride).alias("pos"), F.col("p.value").alias("v"), "y")


def _mean(a: str) -> str:
    return f"(aggregate({a}, 0.0D, (s, x) -> s + x) / size({a}))"


def _moment(a: str, m: str, k: int) -> str:
    return f"(aggregate({a}, 0.0D, (s, x) -> s + power(x - {m}, {k})) / size({a}))"


def statistics(windows: DataFrame) -> DataFrame:
    """The 23 features that need no transform: level, spread, changes, autocorrelation, shape, quantiles, zero crossings."""
    d = windows.withColumn("d1", F.expr("transform(sequence(1, size(v) - 1), i -> v[i] - v[i - 1])"))
    d = d.withColumn("d2", F.expr("transform(sequence(1, size(d1) - 1), i -> d1[i] - d1[i - 1])")).withColumn("mean", F.expr(_mean("v")))
    d = d.withColumn("var", F.expr(_moment("v", "mean", 2))).withColumn("std", F.sqrt("var")).withColumn("s", F.sort_array("v")).withColumn("c", F.expr("transform(v, x -> x - mean)"))
    d = d.withColumn("_m1", F.expr(_mean("d1"))).withColumn("_m2", F.expr(_mean("d2")))
    lag = lambda k: F.expr(f"aggregate(sequence({k}, size(c) - 1), 0.0D, (s, i) -> s + c[i] * c[i - {k}]) / size(c) / (var + 1e-12)").alias(f"ac{k}")
    at = lambda q: F.expr(f"s[cast(floor({q} * (size(s) - 1)) as int)] + ({q} * (size(s) - 1) - floor({q} * (size(s) - 1))) * (s[cast(ceil({q} * (size(s) - 1)) as int)] - s[cast(floor({q} * (size(s) - 1)) as int)])")
    return d.select(
        "series", "win", "pos", "y", "v", "mean", "std",
        F.expr("s[0]").alias("min"), F.expr("s[size(s) - 1]").alias("max"), F.expr("s[size(s) - 1] - s[0]").alias("range"),
        F.sqrt(F.expr(_moment("v", "0.0D", 2))).alias("rms"),
        F.expr(_mean("transform(d1, x -> abs(x))")).alias("abs_d1"), F.sqrt(F.expr(_moment("d1", "_m1", 2))).alias("std_d1"),
        F.expr(_mean("transform(d2, x -> abs(x))")).alias("abs_d2"), F.sqrt(F.expr(_moment("d2", "_m2", 2))).alias("std_d2"),
        lag(1), lag(2), lag(5), lag(10),
        F.expr(f"{_moment('v', 'mean', 3)} / (power(std, 3) + 1e-12)").alias("skew"), F.expr(f"{_moment('v', 'mean', 4)} / (var * var + 1e-12) - 3").alias("kurt"),
        at(0.1).alias("q10"), at(0.5).alias("q50"), at(0.9).alias("q90"), (at(0.75) - at(0.25)).alias("iqr"),
        F.expr("aggregate(sequence(1, size(c) - 1), 0.0D, (s, i) -> s + CASE WHEN c[i] * c[i - 1] < 0 THEN 1.0D ELSE 0.0D END) / (size(c) - 1)").alias("zero_cross"),
    )


@F.pandas_udf(_SPECTRAL)
def spectrum(values: pd.Series) -> pd.DataFrame:
    """Spectral entropy, crest factor, strongest frequency and four band shares of each window, without its mean."""
    x = np.stack(values.to_numpy()).astype(float)
    power = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)) ** 2
    share = power / (power.sum(axis=1, keepdims=True) + 1e-12)
    bands = [b.sum(axis=1) for b in np.array_split(share[:, 1:], 4, axis=1)]
    rms = np.sqrt((x**2).mean(axis=1))
    return pd.DataFrame({"entropy": -(share * np.log(share + 1e-12)).sum(axis=1), "crest": np.abs(x).max(axis=1) / (rms + 1e-12), "peak": power[:, 1:].argmax(axis=1) + 1, **{f"b{k + 1}": b for k, b in enumerate(bands)}})


def describe(windows: DataFrame) -> DataFrame:
    """All 28 features; the five spectral ones come from one Arrow batch function."""
    f = statistics(windows).withColumn("f", spectrum("v"))
    return f.select(*[c for c in f.columns if c not in ("v", "f")], "f.*")


def channel_features(windows: DataFrame) -> DataFrame:
    """Eight features of each window: mean, deviation, least, largest, range, rms, mean change, lag-1 autocorrelation."""
    return statistics(windows).select("series", "win", "mean", "std", "min", "max", "range", "rms", "abs_d1", "ac1")


def stretches(series: DataFrame, halo: int) -> DataFrame:
    """series cut into stretches of ``STRETCH`` points, each with ``halo`` points of its neighbours on either side.

    A frame of up to ``halo`` points each way then lies inside a stretch, so a series of any length is spread over all tasks.
    """
    first, last = (F.floor((F.col("pos") + d) / STRETCH) for d in (-halo, halo))
    return series.withColumn("_stretch", F.explode(F.sequence(first, last)))


def _inner(dealt: DataFrame) -> DataFrame:
    """The points that are in their own stretch: each point of the series once."""
    return dealt.where(F.floor(F.col("pos") / STRETCH) == F.col("_stretch")).drop("_stretch")


def _moving(value: str, k: int) -> tuple[Column, Column]:
    frame = W.partitionBy("series", "_stretch").orderBy("pos").rowsBetween(-(k // 2), k // 2)
    return F.avg(value).over(frame), F.stddev_pop(value).over(frame)


def moving(series: DataFrame, value: str, k: int) -> DataFrame:
    """series with m and s: centred mean and population deviation over 2 (k // 2) + 1 points, shorter at the ends."""
    m, s = _moving(value, k)
    return _inner(stretches(series, k // 2).withColumns({"m": m, "s": s}))


def one_liners(series: DataFrame) -> DataFrame:
    """series with d (change) and one column for each statistic: base - (u * mean_k + c * deviation_k), k = 0 the base alone."""
    dealt = stretches(series, max(SMOOTHING) // 2 + 1)
    change = F.col("value") - F.lag("value").over(W.partitionBy("series", "_stretch").orderBy("pos"))
    s = dealt.withColumn("d", F.coalesce(change, F.lit(0.0))).withColumn("a", F.abs("d"))
    smooth = {}
    for b, k in product("ad", SMOOTHING):
        m, sd = _moving(b, k)
        smooth[f"{b}m{k}"], smooth[f"{b}s{k}"] = m, sd
    s = s.withColumns(smooth)
    stats = {f"{b}_0": F.col(b) for b in "ad"}
    for b, k, u, c in product("ad", SMOOTHING, SPREADS, OFFSETS):
        stats[f"{b}_{k}_{u}_{c}"] = F.col(b) - (F.lit(float(u)) * F.col(f"{b}m{k}") + F.lit(float(c)) * F.col(f"{b}s{k}"))
    return _inner(s.select("series", "pos", "_stretch", "value", "label", *[v.alias(n) for n, v in stats.items()]))


def one_liner_names() -> list[str]:
    return [f"{b}_0" for b in "ad"] + [f"{b}_{k}_{u}_{c}" for b, k, u, c in product("ad", SMOOTHING, SPREADS, OFFSETS)]


def _long(stats: DataFrame, names: list[str]) -> DataFrame:
    p = F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("value")) for n in names]))
    return stats.select("series", "pos", "label", p.alias("p")).select("series", "pos", "label", "p.stat", "p.value")


def argmax_trivial(series: DataFrame, least: int = 50) -> DataFrame:
    """(series, trivial, hits): is the largest value of any statistic labelled. Too short or unlabelled series are trivial.

    One aggregation: each statistic's largest (value, first position) and its label, combined before the shuffle.
    """
    names = one_liner_names()
    stats = one_liners(series)
    tops = [F.max(F.struct(F.col(n).alias("v"), (-F.col("pos")).alias("p"), F.col("label").alias("l"))).alias(n) for n in names]
    g = stats.groupBy("series").agg(F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_l"), *tops)
    found = sum((F.col(f"{n}.l") for n in names), F.lit(0))
    return g.select("series", found.cast("int").alias("hits"), ((F.col("_n") < least) | (F.col("_l") == 0) | (found > 0)).alias("trivial"))


def permutation_trivial(series: DataFrame, names: list[str], shifts: int = 99, level: float = 0.95) -> DataFrame:
    """(series, observed, threshold, trivial): best one-liner AUC against circular shifts of the labels.

    Ranks are computed once; a shift moves only the labelled positions, so the join is of labels times shifts, not points.
    """
    n = F.count(F.lit(1)).over(W.partitionBy("series"))
    ranks = _long(one_liners(series), names).withColumn("r", average_rank(["series", "stat"], "value")).select("series", "stat", "pos", "r")
    lab = series.withColumn("n", n).where("label = 1").withColumn("a", F.count(F.lit(1)).over(W.partitionBy("series")))
    step = F.explode(F.sequence(F.lit(0), F.lit(shifts))).alias("shift")
    moved = lab.select("series", "n", "a", "pos", step).select("series", "n", "a", "shift", F.expr(f"pmod(pos + cast(shift * n / {shifts + 1} as bigint), n)").alias("pos"))
    sums = moved.join(ranks, ["series", "pos"]).groupBy("series", "stat", "shift", "n", "a").agg(F.sum("r").alias("r"))
    auc = sums.where("a < n").withColumn("u", F.expr("(r - a * (a + 1) / 2.0D) / (a * (n - a))"))
    best = auc.groupBy("series", "shift").agg(F.max(F.greatest("u", 1 - F.col("u"))).alias("b"))
    g = best.groupBy("series").agg(F.max(F.when(F.col("shift") == 0, F.col("b"))).alias("observed"), F.percentile(F.when(F.col("shift") > 0, F.col("b")), level).alias("threshold"))
    return g.withColumn("trivial", F.col("observed") > F.col("threshold"))


def calibration(series: DataFrame, names: list[str]) -> DataFrame:
    """(stat, argmax_rate, mean_auc, top1_precision) over the series: how often a one-liner alone would do."""
    long = _long(one_liners(series), names)
    w = W.partitionBy("series", "stat")
    r = long.withColumn("r", average_rank(["series", "stat"], "value")).withColumn("k", F.row_number().over(w.orderBy(F.col("value").desc(), "pos"))).withColumn("n", F.count(F.lit(1)).over(w))
    a = F.sum("label")
    g = r.groupBy("series", "stat").agg(F.max(F.when(F.col("k") == 1, F.col("label"))).alias("hit"), F.expr("CASE WHEN sum(label) > 0 AND sum(label) < count(1) THEN (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0D) / (sum(label) * (count(1) - sum(label))) END").alias("auc"), F.avg(F.when(F.col("k") <= F.ceil(F.col("n") * 0.01), F.col("label"))).alias("p"))
    return g.groupBy("stat").agg(F.avg("hit").alias("argmax_rate"), F.avg("auc").alias("mean_auc"), F.avg("p").alias("top1_precision"))


def window_scores(series: DataFrame, score: str, width: int = WIDTH, stride: int = STRIDE) -> DataFrame:
    """(series, win, score, y): the largest score and label in each whole window; missing scores are skipped."""
    k = -(-width // stride)
    wins = F.expr(f"filter(transform(sequence(0, {k - 1}), i -> floor(pos / {stride}) - i), w -> w >= 0 AND pos < w * {stride} + {width})")
    g = series.select("series", score, "label", F.explode(wins).alias("win")).groupBy("series", "win").agg(F.max(score).alias("score"), F.max("label").alias("y"), F.count(F.lit(1)).alias("_n"))
    return g.where(F.col("_n") == width).drop("_n")
