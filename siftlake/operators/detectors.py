"""Unsupervised detectors. Each gives (dataset, row_id, score), larger for more anomalous rows.

A detector is fitted on ``train`` and scores ``rows``; without ``train`` it is fitted on the rows it scores. Marginal detectors
are aggregations and joins on feature bins; those that need a fitted model are fitted for each data set on a capped sample and
scored by expressions or Arrow batches over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions.ranks import running_totals, z_score
from siftlake.operators import space
from siftlake.operators.spatial import CellTree
from siftlake.session import stored

SAMPLE = 2000  #: rows of a data set that a model is fitted on
PART = 50_000  #: rows of a data set scored in one group
MOST_RESIDUALS = 120  #: features that the linear residual takes

Detector = Callable[[DataFrame, tuple[str, ...], DataFrame | None], DataFrame]
_registry: dict[str, Detector] = {}


def detector(name: str) -> Callable[[Detector], Detector]:
    """Register a detector under a variant name."""

    def add(f: Detector) -> Detector:
        _registry[name] = f
        return f

    return add


def pool(names: list[str] | None = None) -> dict[str, Detector]:
    return {n: _registry[n] for n in names or sorted(_registry)}


def run_pool(rows: DataFrame, features: tuple[str, ...], names: list[str] | None = None, train: DataFrame | None = None) -> DataFrame:
    """(dataset, detector, row_id, score) of several detectors, fitted on ``train`` or on the rows."""
    chosen = pool(names)
    near = {n: m for n in chosen if (m := re.fullmatch(r"(KNN|LOF)_k(\d+)", n))}
    parts = [f(rows, features, train).select("dataset", F.lit(n).alias("detector"), "row_id", "score") for n, f in chosen.items() if n not in near]
    if near:
        parts.append(neighbour_pool(rows, features, {n: (m[1], int(m[2])) for n, m in near.items()}, train))
    return reduce(DataFrame.unionByName, parts)


def fit_and_score(train: DataFrame, rows: DataFrame, features: tuple[str, ...], names: list[str] | None = None) -> DataFrame:
    """``run_pool`` without the detectors that fail on a data set: those with a score that is no finite number, or with the
    same score for every row."""
    scores = stored(run_pool(rows, features, names, train), "scores")
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    by = ["dataset", "detector"]
    fine = scores.groupBy(*by).agg(F.max(bad).alias("bad"), F.stddev_pop("score").alias("sd")).where("NOT bad AND sd >= 1e-12").select(*by)
    return scores.join(fine, by)


def long(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    p = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    return rows.select("dataset", "row_id", p.alias("p")).select("dataset", "row_id", "p.feature", "p.value")


def _factors(n: DataFrame, inside: DataFrame, k: int) -> DataFrame:
    """(dataset, row_id, score): local outlier factors of the rows whose neighbours are ``n``, among rows whose are ``inside``."""

    def density(n: DataFrame, radius: DataFrame) -> DataFrame:
        reach = n.join(radius, ["dataset", "other"]).groupBy("dataset", "row_id")
        return reach.agg(F.try_divide(F.lit(1.0), F.avg(F.greatest("distance", "radius"))).alias("lrd"))

    own_rows = n is inside
    n, inside = n.where(F.col("place") <= k), inside.where(F.col("place") <= k)
    radius = inside.groupBy("dataset", F.col("row_id").alias("other")).agg(F.max("distance").alias("radius"))
    own = stored(density(n, radius), "densities")
    theirs = (own if own_rows else density(inside, radius)).select("dataset", F.col("row_id").alias("other"), F.col("lrd").alias("lrd_other"))
    m = n.join(theirs, ["dataset", "other"]).groupBy("dataset", "row_id").agg(F.avg("lrd_other").alias("m"))
    return m.join(own, ["dataset", "row_id"]).select("dataset", "row_id", F.try_divide("m", "lrd").alias("score"))


def neighbour_pool(rows: DataFrame, features: tuple[str, ...], kinds: dict[str, tuple[str, int]], train: DataFrame | None = None) -> DataFrame:
    """(dataset, detector, row_id, score) of KNN and LOF for several k: one tree and one search of each side, for the largest k.

    ``kinds`` gives each detector's kind and k. KNN is the distance to the k-th nearest other row of ``train``; LOF the mean local
    reachability density of the neighbours in ``train`` over one's own.
    """
    most = max(k for _, k in kinds.values())
    tree = CellTree.build(rows if train is None else train, features, most)
    n = stored(tree.search(rows, most), "neighbours")
    parts = []
    if knn_ := {name: k for name, (kind, k) in kinds.items() if kind == "KNN"}:
        listed = F.explode(F.array(*[F.struct(F.lit(name).alias("detector"), F.lit(k).alias("k")) for name, k in knn_.items()])).alias("v")
        far = n.groupBy("dataset", "row_id").agg(*[F.max(F.when(F.col("place") <= k, F.col("distance"))).alias(f"k{k}") for k in set(knn_.values())])
        at = reduce(lambda c, k: c.when(F.col("v.k") == k, F.col(f"k{k}")), sorted(set(knn_.values())), F.when(F.lit(False), F.lit(0.0)))
        parts.append(far.select("*", listed).select("dataset", "v.detector", "row_id", at.alias("score")))
    if lofs := {name: k for name, (kind, k) in kinds.items() if kind == "LOF"}:
        inside = n if train is None else stored(tree.search(train, max(lofs.values())), "neighbours")
        parts += [_factors(n, inside, k).select("dataset", F.lit(name).alias("detector"), "row_id", "score") for name, k in lofs.items()]
    return reduce(DataFrame.unionByName, parts)


def knn(rows: DataFrame, features: tuple[str, ...], k: int = 10, train: DataFrame | None = None) -> DataFrame:
    """Distance to the k-th nearest other row of ``train``."""
    return neighbour_pool(rows, features, {"KNN": ("KNN", k)}, train).drop("detector")


def lof(rows: DataFrame, features: tuple[str, ...], k: int = 20, train: DataFrame | None = None) -> DataFrame:
    """Mean local reachability density of the neighbours in ``train`` over one's own."""
    return neighbour_pool(rows, features, {"LOF": ("LOF", k)}, train).drop("detector")


def binned(long_rows: DataFrame, bins: int, train: DataFrame | None = None) -> DataFrame:
    """long rows with bin 1..bins over each feature's range in ``train``: the last bin is closed, values outside fall into the
    end bins, and a constant feature is one bin."""
    r = (long_rows if train is None else train).groupBy("dataset", "feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))
    b = F.expr(f"CASE WHEN hi = lo THEN 1 ELSE least(greatest(cast(floor((value - lo) / (hi - lo) * {bins}) as int) + 1, 1), {bins}) END")
    return long_rows.join(r, ["dataset", "feature"]).withColumn("bin", b)


def densities(long_rows: DataFrame, bins: int) -> DataFrame:
    """(dataset, feature, bin, density): share of the feature's rows over the share a flat histogram would have."""
    b = binned(long_rows, bins)
    return b.groupBy("dataset", "feature", "bin", "n").agg((F.count(F.lit(1)) / F.col("n") * bins).alias("density")).drop("n")


def hbos(rows: DataFrame, features: tuple[str, ...], bins: int = 20, epsilon: float = 1e-6, train: DataFrame | None = None) -> DataFrame:
    """Sum over features of the log-inverse histogram density; a bin without a training row has none."""
    f = long(rows, features)
    t = f if train is None else long(train, features)
    scored = binned(f, bins, t).join(densities(t, bins), ["dataset", "feature", "bin"], "left")
    density = F.coalesce("density", F.lit(0.0))
    return scored.groupBy("dataset", "row_id").agg(F.sum(-F.ln(density + epsilon)).alias("score"))


def tails(rows: DataFrame, features: tuple[str, ...], splits: int | None = None, train: DataFrame | None = None) -> DataFrame:
    """(dataset, row_id, feature, left, right, skew): -ln of each tail's empirical probability, and the feature's skewness.

    The distribution is that of the training rows and the row itself. Equal values are one row of the running count, so
    repeated values cost no more than their number of distinct ones; ``splits`` deals a data set's values over so many tasks.
    """
    f = long(rows, features)
    t = f if train is None else long(train, features)
    by, own = ["dataset", "feature"], int(train is not None)
    values = t.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("c"))
    if own:
        values = values.unionByName(f.select(*by, "value", F.lit(0).cast("bigint").alias("c"))).groupBy(*by, "value").agg(F.sum("c").alias("c"))
    c = running_totals(values, by, "value", ["c"], splits)
    left = (F.col("all_c") - F.col("cum_c") + F.col("c") + own) / (F.col("all_c") + own)
    p = c.select(*by, "value", (-F.ln(left)).alias("left"), (-F.ln((F.col("cum_c") + own) / (F.col("all_c") + own))).alias("right"))
    skew = t.groupBy(*by).agg(F.coalesce(F.skewness("value"), F.lit(0.0)).alias("skew"))
    return f.join(p, [*by, "value"]).join(skew, by)


def ecod(rows: DataFrame, features: tuple[str, ...], splits: int | None = None, train: DataFrame | None = None) -> DataFrame:
    """Largest of the summed left tails, right tails and the tails that skewness chooses."""
    chosen = F.when(F.col("skew") < 0, F.col("left")).otherwise(F.col("right"))
    return tails(rows, features, splits, train).groupBy("dataset", "row_id").agg(F.greatest(F.sum("left"), F.sum("right"), F.sum(chosen)).alias("score"))


def copod(rows: DataFrame, features: tuple[str, ...], splits: int | None = None, train: DataFrame | None = None) -> DataFrame:
    """Sum over features of the larger of the mean tail and the tail that skewness chooses."""
    chosen = F.when(F.col("skew") < 0, F.col("left")).when(F.col("skew") > 0, F.col("right")).otherwise(F.col("left") + F.col("right"))
    found = tails(rows, features, splits, train)
    return found.groupBy("dataset", "row_id").agg(F.sum(F.greatest((F.col("left") + F.col("right")) / 2, chosen)).alias("score"))


def pca(rows: DataFrame, features: tuple[str, ...], kept: float = 0.5, train: DataFrame | None = None) -> DataFrame:
    """Distances of the standardised row to the first axes that hold ``kept`` of the variance, each over its share of it."""
    z = space.standardise(rows, features, train)
    axes = space.principal_axes(z if train is None else space.standardise(train, features), features)
    total = "aggregate(values, 0.0D, (s, x) -> s + x)"
    before = "transform(values, (v, i) -> aggregate(slice(values, 1, i), 0.0D, (s, x) -> s + x))"
    axes = axes.withColumn("u", F.expr(f"zip_with({before}, values, (b, v) -> CASE WHEN b < {kept} * {total} - 1e-12 AND v > 1e-9 THEN {total} / v ELSE 0.0D END)"))
    x = z.join(axes.select("dataset", "axes", "u"), "dataset").withColumn("_x", F.array(*features))
    score = "aggregate(zip_with(axes, u, (a, w) -> w * sqrt(aggregate(zip_with(a, _x, (p, q) -> (p - q) * (p - q)), 0.0D, (s, t) -> s + t))), 0.0D, (s, t) -> s + t)"
    return x.select("dataset", "row_id", F.expr(score).alias("score"))


def cblof(rows: DataFrame, features: tuple[str, ...], clusters: int = 8, alpha: float = 0.9, beta: float = 5.0, train: DataFrame | None = None) -> DataFrame:
    """Distance to the centre of the own cluster if it is large, else to the nearest large one.

    Large clusters, by size, are those that hold ``alpha`` of the training rows or are ``beta`` times the next.
    """
    if train is None:
        c = fitted = space.kmeans(space.embed(rows, features), clusters)
    else:
        seen = space.embed(train, features)
        fitted = space.kmeans(seen, clusters)
        c = space.kmeans(space.embed(rows, features, train=train), clusters, train=seen)
    d = fitted.select("dataset", "cluster", F.posexplode("z").alias("i", "v")).groupBy("dataset", "cluster", "i").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    centre = d.groupBy("dataset", "cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    w = W.partitionBy("dataset").orderBy(F.col("n").desc(), "cluster")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ratio = F.coalesce(F.max(F.when(F.col("_r") >= beta, 1)).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    centre = centre.withColumn("_b", before).withColumn("_r", F.lag("n").over(w) / F.col("n")).withColumn("large", (F.col("_b") < alpha * F.sum("n").over(W.partitionBy("dataset"))) & (ratio == 0))
    listed = centre.groupBy("dataset").agg(F.collect_list(F.struct("cluster", "large", "c")).alias("cs"))
    dist = "sqrt(aggregate(zip_with(k.c, z, (a, b) -> (a - b) * (a - b)), 0.0D, (s, t) -> s + t))"
    own = f"array_min(transform(filter(cs, k -> k.large AND k.cluster = cluster), k -> {dist}))"
    any_large = f"array_min(transform(filter(cs, k -> k.large), k -> {dist}))"
    return c.join(listed, "dataset").select("dataset", "row_id", F.coalesce(F.expr(own), F.expr(any_large)).alias("score"))


def loda(rows: DataFrame, features: tuple[str, ...], bins: int = 10, cuts: int = 100, seed: int = 0, train: DataFrame | None = None) -> DataFrame:
    """Mean log-inverse density over histograms of random sparse projections.

    Projections are never rows: a task reduces its rows to their least and largest projections, parts of bounded size count
    theirs by bins, and parts again are scored by their data set's histograms, a row for each data set, in cogroups.
    """
    rng = np.random.default_rng(seed)
    d, used = len(features), max(1, int(np.sqrt(len(features))))
    projections = []
    for _ in range(cuts):
        at = rng.choice(d, used, replace=False)
        projections.append((rng.normal(size=used), at))
    names = list(features)
    z = space.standardise(rows, features, train).select("dataset", "row_id", *[F.col(f).cast("double").alias(f) for f in names])
    seen = z if train is None else space.standardise(train, features).select("dataset", "row_id", *[F.col(f).cast("double").alias(f) for f in names])

    def projected(x: np.ndarray) -> np.ndarray:
        return np.stack([sum((float(a) * x[:, i] for a, i in zip(w, at, strict=True)), np.zeros(len(x))) for w, at in projections])

    def placed(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Bins from 0, as ``binned`` numbers them from 1."""
        flat = (hi == lo) | np.isnan(hi)
        share = (p - lo[:, None]) / np.where(flat, 1.0, hi - lo)[:, None]
        return np.where(flat[:, None], 0, np.clip(np.floor(share * bins), 0, bins - 1)).astype(np.int64)

    def ends(batches):
        for b in batches:
            own = np.array(b.column("dataset").to_pylist(), object)
            x = np.stack([b.column(f).to_numpy(zero_copy_only=False) for f in names], axis=1)
            for name in set(own.tolist()) - {None}:
                p = projected(x[own == name])
                yield pa.RecordBatch.from_pydict({"dataset": [name] * cuts, "i": pa.array(range(cuts), pa.int32()), "lo": p.min(axis=1), "hi": p.max(axis=1)})

    r = seen.mapInArrow(ends, "dataset string, i int, lo double, hi double").groupBy("dataset", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    r = r.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("r"))  # ``cuts`` entries
    r = stored(r.select("dataset", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi")), "ranges")

    def count(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(model):
            return pd.DataFrame({"dataset": [], "n": [], "c": []})
        k = placed(projected(own[names].to_numpy(float)), *(np.asarray(model[c].iloc[0]) for c in ("lo", "hi")))
        c = np.bincount((k + np.arange(cuts)[:, None] * bins).ravel(), minlength=cuts * bins)
        return pd.DataFrame({"dataset": [own["dataset"].iloc[0]], "n": [len(own)], "c": [c.tolist()]})

    def score(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(model):
            return pd.DataFrame({"dataset": [], "row_id": [], "score": []})
        k = placed(projected(own[names].to_numpy(float)), *(np.asarray(model[c].iloc[0]) for c in ("lo", "hi")))
        density = np.asarray(model["c"].iloc[0]).reshape(cuts, bins) / model["n"].iloc[0] * bins
        return pd.DataFrame({"dataset": own["dataset"], "row_id": own["row_id"], "score": np.take_along_axis(-np.log(density + 1e-9), k, axis=1).sum(axis=0) / cuts})

    counts = _in_parts(seen, r, count, "dataset string, n bigint, c array<bigint>")
    added = counts.select("dataset", "n", F.posexplode("c").alias("i", "c")).groupBy("dataset", "i").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    model = added.groupBy("dataset").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("c"))
    return _in_parts(z, r.join(model, "dataset"), score, f"dataset string, row_id {rows.schema['row_id'].dataType.simpleString()}, score double")


def _in_parts(rows: DataFrame, models: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], kinds: str) -> DataFrame:
    """f(rows, model) of each part of at most about ``PART`` rows of a data set, with its data set's row of ``models``."""
    parts = rows.groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts"))
    dealt = rows.join(parts, "dataset").withColumn("_part", F.pmod(F.xxhash64("row_id"), F.col("_parts")).cast("int")).drop("_parts")
    models = models.join(parts, "dataset").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.groupBy("dataset", "_part").cogroup(models.groupBy("dataset", "_part")).applyInPandas(f, kinds)


def _forest(x: np.ndarray, trees: int, sample: int, rng: np.random.Generator, share: float = 1.0) -> list[tuple[np.ndarray, ...]]:
    """Isolation trees as arrays: feature, threshold, left and right child, and the path length a leaf stands for. A tree knows
    ``share`` of the features."""
    out = []
    c = lambda n: 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    for _ in range(trees):
        feature, cut, left, right, length = [], [], [], [], []

        def grow(at: np.ndarray, depth: int) -> int:
            k = len(feature)
            for a in (feature, cut, left, right, length):
                a.append(0)
            own = x[at]
            spread = np.flatnonzero((own.max(axis=0) > own.min(axis=0)) & known) if len(at) > 1 else []
            if depth >= limit or not len(spread):
                feature[k], length[k] = -1, depth + c(len(at))
                return k
            f = int(rng.choice(spread))
            t = rng.uniform(own[:, f].min(), own[:, f].max())
            feature[k], cut[k] = f, t
            left[k] = grow(at[own[:, f] < t], depth + 1)
            right[k] = grow(at[own[:, f] >= t], depth + 1)
            return k

        rows = rng.choice(len(x), min(sample, len(x)), replace=False)
        known = np.ones(x.shape[1], bool)
        if share < 1:
            known[rng.permutation(x.shape[1])[max(1, int(share * x.shape[1])) :]] = False
        limit = int(np.ceil(np.log2(max(2, len(rows)))))
        grow(rows, 0)
        out.append(tuple(np.array(a) for a in (feature, cut, left, right, length)))
    return out


def iforest(rows: DataFrame, features: tuple[str, ...], trees: int = 100, sample: int = 256, seed: int = 0, train: DataFrame | None = None) -> DataFrame:
    """2 ** (-mean path length / expected length), trees grown on capped rows of each data set.

    A data set's rows are dealt into parts, and each part meets the forest, a row for each data set, by a cogroup.
    """
    place = F.row_number().over(W.partitionBy("dataset").orderBy(F.md5(F.col("row_id").cast("string"))))
    few = (rows if train is None else train).select("dataset", "row_id", *features).withColumn("_k", place).where(F.col("_k") <= SAMPLE)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_k")[list(features)].to_numpy(float)
        grown = _forest(x, trees, sample, np.random.default_rng(seed))
        flat = [{"f": t[0].astype(int).tolist(), "t": t[1].astype(float).tolist(), "l": t[2].astype(int).tolist(), "r": t[3].astype(int).tolist(), "n": t[4].astype(float).tolist()} for t in grown]
        return pd.DataFrame({"dataset": [pdf["dataset"].iloc[0]], "size": [min(sample, len(x))], "trees": [flat]})

    forests = few.groupBy("dataset").applyInPandas(fit, "dataset string, size int, trees array<struct<f:array<int>,t:array<double>,l:array<int>,r:array<int>,n:array<double>>>")
    # rows meet their forest in parts of bounded size, however many rows or data sets there are
    parts = rows.groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts"))
    dealt = rows.select("dataset", "row_id", *features).join(parts, "dataset").withColumn("_part", F.pmod(F.xxhash64("row_id"), F.col("_parts")).cast("int")).drop("_parts")
    forests = forests.join(parts, "dataset").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def score(own: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"dataset": [], "row_id": [], "score": []})
        x, size, total = own[list(features)].to_numpy(float), int(forest["size"].iloc[0]), np.zeros(len(own))
        grown = [tuple(np.asarray(t[k]) for k in "ftlrn") for t in forest["trees"].iloc[0]]
        for f, t, left, right, length in grown:
            total += _path_lengths(x, f, t, left, right, length)
        norm = 2 * (np.log(size - 1) + 0.5772156649) - 2 * (size - 1) / size if size > 2 else 1.0
        return pd.DataFrame({"dataset": own["dataset"], "row_id": own["row_id"], "score": 2.0 ** (-total / len(grown) / norm)})

    met = dealt.groupBy("dataset", "_part").cogroup(forests.groupBy("dataset", "_part"))
    return met.applyInPandas(score, "dataset string, row_id long, score double")


def forest_bank(rows: DataFrame, features: tuple[str, ...], configurations: dict[str, tuple[int, float]], seeds: tuple[int, ...], sample: int = 256, train: DataFrame | None = None) -> DataFrame:
    """(dataset, configuration, seed, row_id, score) of an isolation forest for each configuration (trees, share of features) and seed.

    One table of models, keyed by data set, configuration and seed, is grown on capped rows of each data set, and one pass
    scores the rows: parts of a data set's rows meet all of its forests in a cogroup.
    """
    place = F.row_number().over(W.partitionBy("dataset").orderBy(F.md5(F.col("row_id").cast("string"))))
    few = (rows if train is None else train).select("dataset", "row_id", *features).withColumn("_k", place).where(F.col("_k") <= SAMPLE)
    units = [F.struct(F.lit(c).alias("c"), F.lit(s).alias("s")) for c in configurations for s in seeds]
    keyed = few.withColumn("_u", F.explode(F.array(*units))).select("*", F.col("_u.c").alias("configuration"), F.col("_u.s").alias("seed")).drop("_u")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_k")[list(features)].to_numpy(float)
        one = {c: pdf[c].iloc[0] for c in ("dataset", "configuration", "seed")}
        trees, share = configurations[one["configuration"]]
        grown = _forest(x, trees, sample, np.random.default_rng((int(one["seed"]), trees, round(100 * share))), share)
        flat = [{"f": t[0].astype(int).tolist(), "t": t[1].astype(float).tolist(), "l": t[2].astype(int).tolist(), "r": t[3].astype(int).tolist(), "n": t[4].astype(float).tolist()} for t in grown]
        return pd.DataFrame({c: [v] for c, v in one.items()} | {"size": [min(sample, len(x))], "trees": [flat]})

    tree = "struct<f:array<int>,t:array<double>,l:array<int>,r:array<int>,n:array<double>>"
    models = stored(keyed.groupBy("dataset", "configuration", "seed").applyInPandas(fit, f"dataset string, configuration string, seed int, size int, trees array<{tree}>"), "forests")
    parts = rows.groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts"))
    dealt = rows.select("dataset", "row_id", *features).join(parts, "dataset").withColumn("_part", F.pmod(F.xxhash64("row_id"), F.col("_parts")).cast("int")).drop("_parts")
    models = models.join(parts, "dataset").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def score(own: pd.DataFrame, forests: pd.DataFrame) -> pd.DataFrame:
        x, out = own[list(features)].to_numpy(float), []
        for m in forests.itertuples() if len(own) else ():
            total = np.zeros(len(x))
            for t in m.trees:
                total += _path_lengths(x, *(np.asarray(t[k]) for k in "ftlrn"))
            norm = 2 * (np.log(m.size - 1) + 0.5772156649) - 2 * (m.size - 1) / m.size if m.size > 2 else 1.0
            out.append(pd.DataFrame({"dataset": own["dataset"], "configuration": m.configuration, "seed": m.seed, "row_id": own["row_id"], "score": 2.0 ** (-total / len(m.trees) / norm)}))
        return pd.concat(out) if out else pd.DataFrame({"dataset": [], "configuration": [], "seed": [], "row_id": [], "score": []})

    met = dealt.groupBy("dataset", "_part").cogroup(models.groupBy("dataset", "_part"))
    return met.applyInPandas(score, "dataset string, configuration string, seed int, row_id long, score double")


def _path_lengths(x: np.ndarray, f: np.ndarray, t: np.ndarray, left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What the leaf of each row stands for."""
    node = np.zeros(len(x), int)
    live = np.arange(len(x))[f[node] >= 0]
    while len(live):
        at = node[live]
        node[live] = np.where(x[live, f[at]] < t[at], left[at], right[at])
        live = live[f[node[live]] >= 0]
    return length[node]


def max_z(rows: DataFrame, features: tuple[str, ...], normals_only: bool = False, train: DataFrame | None = None) -> DataFrame:
    """Largest absolute z-score over features; moments of ``train``, of all rows, or of the normal ones."""
    s = train if train is not None else rows.where("y = 0") if normals_only else rows
    stats = s.groupBy("dataset").agg(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f"_{f}") for f in features])
    z = [F.abs((F.col(f) - F.col(f"_{f}.m")) / (F.col(f"_{f}.s") + 1e-9)) for f in features]
    return rows.join(stats, "dataset").select("dataset", "row_id", F.array_max(F.array(*z)).alias("score"))


def linear_residual(rows: DataFrame, features: tuple[str, ...], ridge: float = 1.0, train: DataFrame | None = None) -> DataFrame:
    """Largest absolute residual, in deviations, of each feature's ridge regression on the others, by the training rows.

    Models come from the sums of products of the training rows, one partial aggregation; features are not scaled. Fewer than
    2 or more than 120 features give no row.
    """
    d = len(features)
    t = rows if train is None else train
    if not 2 <= d <= MOST_RESIDUALS:
        return rows.select("dataset", "row_id", F.lit(0.0).alias("score")).where("false")

    @F.pandas_udf("array<array<double>>")
    def solve(n: pd.Series, means: pd.Series, products: pd.Series) -> pd.Series:
        out = []
        for count, m, p in zip(n, means, products, strict=True):
            g = space.covariance(list(m), list(p)) * count
            w = np.zeros((d, d))
            for i in range(d):
                others = [j for j in range(d) if j != i]
                w[i, others] = np.linalg.solve(g[np.ix_(others, others)] + ridge * np.eye(d - 1), g[others, i])
            out.append((np.eye(d) - w).tolist())
        return pd.Series(out)

    model = space.gram(t, features).select("dataset", "means", solve("n", "means", "gram").alias("w"))

    def residuals(x: DataFrame) -> DataFrame:
        x = x.select("dataset", "row_id", F.array(*features).alias("_x")).join(model, "dataset")
        r = "transform(w, a -> aggregate(zip_with(a, zip_with(_x, means, (x, m) -> x - m), (p, q) -> p * q), 0.0D, (s, t) -> s + t))"
        return x.select("dataset", "row_id", F.expr(r).alias("r"))

    spread = residuals(t).groupBy("dataset").agg(F.array(*[F.stddev_pop(F.col("r")[i]) for i in range(d)]).alias("s"))
    return residuals(rows).join(spread, "dataset").select("dataset", "row_id", F.expr("array_max(zip_with(r, s, (a, b) -> abs(a) / (b + 1e-9)))").alias("score"))


def ensemble(scores: DataFrame, how: str = "mean") -> DataFrame:
    """(dataset, row_id, score): mean or largest z-score of the detectors of a row."""
    z = scores.withColumn("z", F.coalesce(z_score(["dataset", "detector"], "score"), F.lit(0.0)))
    return z.groupBy("dataset", "row_id").agg((F.avg("z") if how == "mean" else F.max("z")).alias("score"))


def nearest_labelled(rows: DataFrame, labelled: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Negative distance to the nearest labelled anomaly, of a capped labelled set."""
    n = space.neighbours(rows, labelled.where("y = 1"), features, 1)
    return n.select("dataset", "row_id", (-F.col("distance")).alias("score"))


def supervised(train: DataFrame, rows: DataFrame, features: tuple[str, ...], kind: str = "logistic") -> DataFrame:
    """(dataset, row_id, score) of a classifier fitted on labelled rows: logistic (balanced), forest or boosted."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    pack = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    share = train.agg(F.avg("y")).first()[0] or 0.5
    data = pack.transform(train).withColumn("label", F.col("y").cast("double")).withColumn("weight", F.when(F.col("y") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    model = {"logistic": LogisticRegression(weightCol="weight", regParam=0.01), "forest": RandomForestClassifier(numTrees=30, seed=0), "boosted": GBTClassifier(maxIter=10, seed=0)}[kind].fit(data)
    return model.transform(pack.transform(rows)).select("dataset", "row_id", vector_to_array("probability")[1].alias("score"))


for _k in (3, 5, 10, 20, 35, 50):
    detector(f"KNN_k{_k}")(lambda r, f, t=None, k=_k: knn(r, f, k, t))
for _k in (5, 10, 20, 35, 50):
    detector(f"LOF_k{_k}")(lambda r, f, t=None, k=_k: lof(r, f, k, t))
for _b in (5, 10, 20, 50):
    detector(f"HBOS_{_b}")(lambda r, f, t=None, b=_b: hbos(r, f, b, train=t))
for _p in (0.3, 0.5, 0.7, 0.9):
    detector(f"PCA_{_p}")(lambda r, f, t=None, p=_p: pca(r, f, p, t))
for _c in (4, 8, 16):
    detector(f"CBLOF_{_c}")(lambda r, f, t=None, c=_c: cblof(r, f, c, train=t))
for _b in (5, 10, 20):
    detector(f"LODA_{_b}")(lambda r, f, t=None, b=_b: loda(r, f, b, train=t))
for _n in (50, 100, 200):
    for _s in (128, 256):
        detector(f"IForest_{_n}" + ("" if _s == 256 else f"_{_s}"))(lambda r, f, t=None, n=_n, s=_s: iforest(r, f, n, s, train=t))
detector("ECOD")(lambda r, f, t=None: ecod(r, f, train=t))
detector("COPOD")(lambda r, f, t=None: copod(r, f, train=t))
detector("MaxZ")(lambda r, f, t=None: max_z(r, f, train=t))
detector("LinRes")(lambda r, f, t=None: linear_residual(r, f, train=t))
