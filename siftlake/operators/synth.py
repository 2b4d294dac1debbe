"""Synthetic anomalies from normal rows; draws are hashes of (seed, tag, index), the same in any engine.

Generators take ``normals`` (dataset, row_id and feature columns) and give ``n`` rows for each data set.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.operators import space
from siftlake.operators.spatial import CellTree
from siftlake.session import stored

DRAWN = 500_000  #: draws that are sent to the normals; more are joined by shuffles


def hash_uniform(seed: object, tag: object, index: Column) -> Column:
    """In [0, 1): from MD5 of 'seed:tag:index'."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(str(tag)) if not isinstance(tag, Column) else tag, index.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_box(rows: DataFrame, features: tuple[str, ...], n: int, seed: int) -> DataFrame:
    """(dataset, row_id, features): uniform draws in each data set's bounding box; a constant feature spans 1."""
    box = rows.groupBy("dataset").agg(*[F.struct(F.min(f).alias("lo"), F.max(f).alias("hi")).alias(f"b_{f}") for f in features])
    i = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("row_id")
    at = F.col("row_id")
    return box.select("*", i).select("dataset", "row_id", *[(F.col(f"b_{f}.lo") + hash_uniform(seed, f, at) * F.expr(f"CASE WHEN b_{f}.hi = b_{f}.lo THEN 1.0D ELSE b_{f}.hi - b_{f}.lo END")).alias(f) for f in features])


def _numbered(normals: DataFrame) -> DataFrame:
    """normals with _i, their place from 0 in the order of row_id, and _n, their number."""
    w = W.partitionBy("dataset")
    return normals.withColumn("_i", F.row_number().over(w.orderBy("row_id")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))


def draws(normals: DataFrame, n: int, seed: object, donors: int = 1) -> DataFrame:
    """(dataset, k, base, donor_0..): for each synthetic row the places of its base and donors. n rows a data set."""
    size = normals.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))
    s = size.select("dataset", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("k"))
    pick = lambda tag: F.floor(hash_uniform(seed, tag, F.col("k")) * F.col("_n")).cast("bigint")
    return s.select("dataset", "k", pick("base").alias("base"), *[pick(f"donor{j}").alias(f"donor_{j}") for j in range(donors)])


def _joined(normals: DataFrame, drawn: DataFrame, features: tuple[str, ...], donors: int) -> DataFrame:
    """The draws with the features of their base and donors. The planner sizes stored normals too low, so the join is told that
    the draws, ``n`` a data set, are the smaller side."""
    own = _numbered(normals).select("dataset", "_i", *features)
    drawn = stored(drawn, "draws")
    how = "broadcast" if drawn.count() <= DRAWN else "merge"
    out = drawn.hint(how).join(own.withColumnRenamed("_i", "base"), ["dataset", "base"])
    for j in range(donors):
        out = out.hint(how).join(own.select("dataset", F.col("_i").alias(f"donor_{j}"), *[F.col(f).alias(f"{f}_{j}") for f in features]), ["dataset", f"donor_{j}"])
    return out


def shuffle_features(normals: DataFrame, features: tuple[str, ...], n: int, seed: object, k: int, alpha: float = 1.0, multi: bool = False) -> DataFrame:
    """(dataset, k, features): ``k`` hash-chosen features take another row's value, blended by ``alpha``; ``multi`` takes
    each feature from a donor of its own."""
    donors = len(features) if multi else 1
    s = _joined(normals, draws(normals, n, seed, donors), features, donors)
    order = F.array_sort(F.array(*[F.struct(hash_uniform(seed, f"f:{f}", F.col("k")).alias("u"), F.lit(f).alias("f")) for f in features]))
    s = s.withColumn("_swap", F.slice(F.transform(order, lambda o: o["f"]), 1, k))
    return s.select("dataset", "k", *[F.when(F.array_contains("_swap", f), (1 - alpha) * F.col(f) + alpha * F.col(f"{f}_{j if multi else 0}")).otherwise(F.col(f)).alias(f) for j, f in enumerate(features)])


def histogram(normals: DataFrame, features: tuple[str, ...], bins: int, beta: float, band: tuple[float, float] = (0.02, 0.98)) -> DataFrame:
    """(dataset, feature, bin, lo, hi, upto): the running share of bins weighted by density ** beta inside the band."""
    from siftlake.operators.detectors import long

    f = long(normals, features)
    q = f.groupBy("dataset", "feature").agg(F.percentile("value", band[0]).alias("a"), F.percentile("value", band[1]).alias("b"))
    inside = f.join(q, ["dataset", "feature"]).where("value >= a AND value <= b AND b > a")
    binned = inside.withColumn("bin", F.expr(f"least(cast(floor((value - a) / (b - a) * {bins}) as int), {bins - 1})"))
    h = binned.groupBy("dataset", "feature", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("a").alias("a"), F.min("b").alias("b"))
    total = W.partitionBy("dataset", "feature")
    weight = F.pow(F.col("c") / F.sum("c").over(total), F.lit(float(beta)))
    h = h.withColumn("w", weight).withColumn("upto", F.sum("w").over(total.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) / F.sum("w").over(total))
    width = (F.col("b") - F.col("a")) / bins
    return h.select("dataset", "feature", "bin", "c", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), "upto", F.coalesce(F.lag("upto").over(total.orderBy("bin")), F.lit(0.0)).alias("since"))


def histogram_draw(normals: DataFrame, features: tuple[str, ...], n: int, seed: object, beta: float = 1.0, share: float = 0.4, bins: int = 30, observed: bool = True) -> DataFrame:
    """(dataset, k, features): a hash-drawn ``share`` of the features redrawn from density ** beta bins.

    ``observed`` takes an observed value of the bin (its (floor(u * count) + 1)-th), else a uniform point inside it. The
    draw meets the bins by an equi-join on feature and a range of tens of bins.
    """
    from siftlake.operators.detectors import long

    base = _joined(normals, draws(normals, n, seed, 0), features, 0)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features]))
    s = base.select("dataset", "k", cells.alias("p")).select("dataset", "k", "p.*")
    tag = lambda t: F.concat(F.lit(f"{t}:"), F.col("feature"))
    s = s.withColumn("_do", hash_uniform(seed, tag("do"), F.col("k")) < share).withColumn("_u", hash_uniform(seed, tag("bin"), F.col("k"))).withColumn("_v", hash_uniform(seed, tag("in"), F.col("k")))
    h = histogram(normals, features, bins, beta)
    drawn = s.alias("s").join(h.alias("h"), (F.col("s.dataset") == F.col("h.dataset")) & (F.col("s.feature") == F.col("h.feature")) & (F.col("_u") >= F.col("since")) & (F.col("_u") < F.col("upto")), "left").select("s.*", "bin", "c", "lo", "hi")
    if observed:
        q = long(normals, features).groupBy("dataset", "feature").agg(F.percentile("value", 0.02).alias("a"), F.percentile("value", 0.98).alias("b"))
        v = long(normals, features).join(q, ["dataset", "feature"]).where("value >= a AND value <= b AND b > a").withColumn("bin", F.expr(f"least(cast(floor((value - a) / (b - a) * {bins}) as int), {bins - 1})"))
        v = v.select("dataset", "feature", "bin", F.col("value").alias("_new"), F.row_number().over(W.partitionBy("dataset", "feature", "bin").orderBy("value", "row_id")).alias("_k"))
        drawn = drawn.withColumn("_k", (F.floor(F.col("_v") * F.col("c")) + 1).cast("int")).join(v, ["dataset", "feature", "bin", "_k"], "left")
    else:
        drawn = drawn.withColumn("_new", F.col("lo") + F.col("_v") * (F.col("hi") - F.col("lo")))
    drawn = drawn.withColumn("value", F.when(F.col("_do") & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("value")))
    return drawn.groupBy("dataset", "k").agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features])


def alpha_spectrum(normals: DataFrame, features: tuple[str, ...], n: int, seed: object, alpha: float) -> DataFrame:
    """From few extreme features (alpha 0) to many typical ones (alpha 1): 1 + alpha (d - 1) features, beta 6 alpha - 4."""
    d = len(features)
    return histogram_draw(normals, features, n, f"{seed}:{alpha}", beta=-4 + 6 * alpha, share=(1 + alpha * (d - 1)) / d)


def mixed_modes(normals: DataFrame, features: tuple[str, ...], n: int, seed: object) -> DataFrame:
    """Rows that alternate between a feature shuffle and an extreme histogram draw (beta -2)."""
    a = shuffle_features(normals, features, n, seed, max(1, len(features) // 2)).where("k % 2 = 0")
    return a.unionByName(histogram_draw(normals, features, n, seed, beta=-2.0).where("k % 2 = 1"))


def elevate(normals: DataFrame, features: tuple[str, ...], n: int, seed: object, low: float = 0.85, high: float = 0.99) -> DataFrame:
    """(dataset, k, features): one hash-chosen feature at a hash-drawn quantile of either tail."""
    s = _joined(normals, draws(normals, n, seed, 0), features, 0)
    grid = [low + (high - low) * j / 7 for j in range(8)]
    q = normals.groupBy("dataset").agg(*[F.percentile(f, F.array(*[F.lit(x) for x in grid] + [F.lit(1 - x) for x in grid])).alias(f"_{f}") for f in features])
    pick = F.floor(hash_uniform(seed, "feature", F.col("k")) * len(features)).cast("int")
    place = F.floor(hash_uniform(seed, "level", F.col("k")) * 16).cast("int")
    s = s.join(q, "dataset").withColumn("_f", pick).withColumn("_p", place)
    return s.select("dataset", "k", *[F.when(F.col("_f") == j, F.expr(f"_{f}[_p]")).otherwise(F.col(f)).alias(f) for j, f in enumerate(features)])


def marginal_probe(normals: DataFrame, features: tuple[str, ...], n: int, seed: object, share: float = 0.05) -> DataFrame:
    """(dataset, k, features): one hash-chosen feature takes a hash-drawn observed value from its lower or upper ``share``."""
    s = _joined(normals, draws(normals, n, seed, 0), features, 0)
    names = {i: f for i, f in enumerate(features)}
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).cast("double").alias("v")) for i, f in names.items()])).alias("u")
    long = normals.select("dataset", "row_id", listed).select("dataset", "row_id", "u.f", "u.v")
    ends = long.groupBy("dataset", "f").agg(F.percentile("v", share).alias("lo"), F.percentile("v", 1 - share).alias("hi"))
    tails = long.join(ends, ["dataset", "f"])
    tails = tails.where("v <= lo").withColumn("s", F.lit(0)).unionAll(tails.where("v >= hi").withColumn("s", F.lit(1)))
    w = W.partitionBy("dataset", "f", "s")
    tails = tails.select("dataset", "f", "s", "v", (F.row_number().over(w.orderBy("v", "row_id")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("c"))
    sizes = tails.groupBy("dataset", "f", "s").agg(F.max("c").alias("c"))
    feature = F.floor(hash_uniform(seed, "feature", F.col("k")) * len(features)).cast("int")
    side = F.when(hash_uniform(seed, "side", F.col("k")) < 0.5, 1).otherwise(0)
    drawn = s.withColumn("f", feature).withColumn("s", side).join(sizes, ["dataset", "f", "s"])
    drawn = drawn.withColumn("i", F.floor(hash_uniform(seed, "value", F.col("k")) * F.col("c")).cast("int")).drop("c")
    drawn = drawn.join(tails.drop("c"), ["dataset", "f", "s", "i"])
    return drawn.select("dataset", "k", *[F.when(F.col("f") == i, F.col("v")).otherwise(F.col(f)).alias(f) for i, f in names.items()])


def dependency_probe(normals: DataFrame, features: tuple[str, ...], n: int, seed: object, share: float = 0.4) -> DataFrame:
    """(dataset, k, features): ``share`` of the features take other rows' values, each its own, so margins stay and dependence goes."""
    return shuffle_features(normals, features, n, seed, max(1, int(share * len(features))), multi=True)


def shift_cluster(rows: DataFrame, held: DataFrame, features: tuple[str, ...], delta: float) -> DataFrame:
    """(dataset, delta, row_id, features): a held-out cluster displaced as one piece and clipped to the range.

    In each feature all its rows move by ``delta`` deviations, away from the mean on the side of the cluster's own mean.
    """
    s = rows.groupBy("dataset").agg(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s"), F.min(f).alias("lo"), F.max(f).alias("hi")).alias(f"_{f}") for f in features])
    own = rows.join(held, ["dataset", "row_id"], "left_semi")
    centre = own.groupBy("dataset").agg(*[F.avg(f).alias(f"_c_{f}") for f in features])
    moved = []
    for f in features:
        side = F.when(F.col(f"_c_{f}") >= F.col(f"_{f}.m"), 1.0).otherwise(-1.0)
        moved.append(F.least(F.greatest(F.col(f) + side * delta * F.col(f"_{f}.s"), F.col(f"_{f}.lo")), F.col(f"_{f}.hi")).alias(f))
    return own.join(s, "dataset").join(centre, "dataset").select("dataset", F.lit(float(delta)).alias("delta"), "row_id", *moved)


def cluster_filter(synthetic: DataFrame, normals: DataFrame, centres: DataFrame, features: tuple[str, ...], level: float = 0.6, least: int = 10) -> DataFrame:
    """Synthetic rows farther from every centre than the normals' ``level`` quantile; all if fewer than ``least`` are."""
    def nearest(df: DataFrame) -> DataFrame:
        c = centres.select("dataset", *[F.col(f).alias(f"_{f}") for f in features])
        d = sum(((F.col(f) - F.col(f"_{f}")) ** 2 for f in features), F.lit(0.0))
        return df.join(c, "dataset").groupBy(*df.columns).agg(F.round(F.sqrt(F.min(d)), 9).alias("_d"))

    cut = nearest(normals.select("dataset", "row_id", *features)).groupBy("dataset").agg(F.percentile("_d", level).alias("_q"))
    s = nearest(synthetic).join(cut, "dataset").withColumn("_far", (F.col("_d") > F.col("_q")).cast("int"))
    return s.withColumn("_m", F.sum("_far").over(W.partitionBy("dataset"))).where((F.col("_far") == 1) | (F.col("_m") < least)).select(*synthetic.columns)


def inject(normals: DataFrame, features: tuple[str, ...], n: int, seed: object, kind: str, share: float = 0.2) -> DataFrame:
    """(dataset, k, features) of one injection type: spike, noise, scale, contextual or cutoff on a share of coordinates."""
    s = _joined(normals, draws(normals, n, seed, 1), features, 1)
    sd = normals.groupBy("dataset").agg(*[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    s = s.join(sd, "dataset")
    out = []
    for f in features:
        u, v = (hash_uniform(seed, f"{t}:{f}", F.col("k")) for t in ("size", "sign"))
        sign = F.when(v < 0.5, -1.0).otherwise(1.0)
        # a normal draw by the sum of twelve uniforms would need twelve hashes; the logistic quantile has a closed form
        logistic = F.ln((u + 1e-9) / (1 - u + 1e-9)) / 1.702
        new = {"spike": F.col(f) + sign * (4 + 4 * u) * F.col(f"_s_{f}"), "noise": F.col(f) + 1.5 * logistic * F.col(f"_s_{f}"), "scale": F.col(f) * (3 + 3 * u), "contextual": F.col(f"{f}_0"), "cutoff": F.lit(0.0)}[kind]
        out.append(F.when(hash_uniform(seed, f"hit:{f}", F.col("k")) < share, new).otherwise(F.col(f)).alias(f))
    return s.select("dataset", "k", *out)


def project_valid(synthetic: DataFrame, normals: DataFrame, features: tuple[str, ...], levels: int = 10) -> DataFrame:
    """Synthetic rows clipped to each feature's range; integer features rounded; features of few levels snapped to one."""
    stats = normals.groupBy("dataset").agg(*[F.struct(F.min(f).alias("lo"), F.max(f).alias("hi"), F.max(F.abs(F.col(f) - F.round(f))).alias("r"), F.countDistinct(f).alias("d")).alias(f"_{f}") for f in features])
    # levels are listed only for features that have few: of the others nothing is gathered
    counted = normals.join(stats, "dataset").select("dataset", *[F.when(F.col(f"_{f}.d") <= levels, F.col(f)).alias(f) for f in features])
    few = counted.groupBy("dataset").agg(*[F.array_sort(F.collect_set(f)).alias(f"_v_{f}") for f in features])
    s = synthetic.join(stats, "dataset").join(few, "dataset")
    out = []
    for f in features:
        clipped = F.least(F.greatest(F.col(f), F.col(f"_{f}.lo")), F.col(f"_{f}.hi"))
        snapped = F.expr(f"array_min(transform(_v_{f}, v -> struct(abs(v - {f}) AS d, v AS v))).v")
        out.append(F.when(F.col(f"_{f}.d") <= levels, snapped).when(F.col(f"_{f}.r") < 1e-9, F.round(clipped)).otherwise(clipped).alias(f))
    return s.select(*[c for c in synthetic.columns if c not in features], *out)


REFERENCE = 1500  #: normals of a data set that the kernel generators know, as their definitions have it
SPARSITY = (50, 70, 85, 95)  #: percentiles that are levels of sparsity or density


def _nearest(points: np.ndarray, z: np.ndarray, k: int) -> np.ndarray:
    """Ascending distances to the ``k`` nearest reference rows, in blocks of points."""
    parts = []
    for a in range(0, len(points), 512):
        p = points[a : a + 512]
        d2 = (p**2).sum(axis=1)[:, None] - 2 * p @ z.T + (z**2).sum(axis=1)
        parts.append(np.sqrt(np.maximum(np.sort(d2, axis=1)[:, :k], 0)))
    return np.concatenate(parts) if parts else np.zeros((0, k))


def level_set(z: np.ndarray, n: int, rng: np.random.Generator, steps: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Rows that walk down the gradient of a kernel density, recorded where they first reach each level of sparsity."""
    near = _nearest(z, z, 11)[:, 1:]
    cuts, h = np.percentile(near.mean(axis=1), SPARSITY), float(np.median(near)) + 1e-9
    p, reached = z[rng.integers(len(z), size=n)].copy(), np.zeros(n, int)
    out, level = [], []
    for _ in range(steps):
        live = np.flatnonzero(reached < len(cuts))
        if not len(live):
            break
        to = z[None] - p[live][:, None]
        d2 = (to**2).sum(axis=2)
        w = np.exp(-(d2 - d2.min(axis=1, keepdims=True)) / (2 * h * h))
        slope = (to * w[:, :, None]).sum(axis=1)
        p[live] -= 0.5 * h * slope / (np.linalg.norm(slope, axis=1, keepdims=True) + 1e-9)
        sparse = _nearest(p[live], z, 11)[:, 1:].mean(axis=1)
        for i, s in zip(live.tolist(), sparse.tolist(), strict=True):
            while reached[i] < len(cuts) and s >= cuts[reached[i]]:
                out.append(p[i].copy())
                level.append(SPARSITY[reached[i]])
                reached[i] += 1
    return np.array(out).reshape(-1, z.shape[1]), np.array(level, float)


def void(z: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Mixtures of two rows, and rows with 40 % of another's coordinates, where a kernel density curves upwards; the level is
    the percentile of density that a point is under."""
    h2 = (float(np.median(_nearest(z, z, 11)[:, 1:])) + 1e-9) ** 2
    d = z.shape[1]
    i, j = rng.integers(len(z), size=(2, 20 * n))
    t = rng.uniform(0.35, 0.65, (20 * n, 1))
    swap = np.argsort(rng.random((20 * n, d)), axis=1) < max(1, int(0.4 * d))
    p = np.where((np.arange(20 * n) % 5 < 3)[:, None], t * z[i] + (1 - t) * z[j], np.where(swap, z[j], z[i]))
    density, curve = np.zeros(len(p)), np.zeros(len(p))
    for a in range(0, len(p), 512):
        d2 = ((p[a : a + 512, None] - z[None]) ** 2).sum(axis=2)
        k = np.exp(-d2 / (2 * h2))
        density[a : a + 512], curve[a : a + 512] = k.mean(axis=1), (k * (d2 / h2 - d)).mean(axis=1)
    p, density = p[curve > 0], density[curve > 0]
    if not len(p):
        return p, np.zeros(0)
    cuts = np.percentile(density, SPARSITY)
    order = np.argsort(density, kind="stable")[:n]
    return p[order], np.array(SPARSITY, float)[np.minimum(np.searchsorted(cuts, density[order], side="left"), len(cuts) - 1)]


SAMPLED = {f.__name__: f for f in (level_set, void)}


class _Space:
    """All normals of every data set in standardised features, and what is needed to draw near them and to go back."""

    def __init__(self, normals: DataFrame, features: tuple[str, ...], n: int, seed: object) -> None:
        self.features, self.n, self.seed = features, n, seed
        stats = normals.groupBy("dataset").agg(*[F.struct(F.avg(f).alias("m"), (F.stddev_pop(f) + 1e-9).alias("s")).alias(f"_{f}") for f in features])
        self.stats = stored(stats, "scales")
        scaled = [((F.col(f) - F.col(f"_{f}.m")) / F.col(f"_{f}.s")).alias(f) for f in features]
        rows = normals.select("dataset", F.col("row_id").cast("bigint").alias("row_id"), *features).dropna().join(self.stats, "dataset")
        self.rows = stored(rows.select("dataset", "row_id", *scaled), "normals")

    def u(self, tag: str, index: Column | None = None) -> Column:
        return hash_uniform(self.seed, tag, F.col("k") if index is None else index)

    def gauss(self, tag: str) -> Column:
        return F.sqrt(-2 * F.ln(1 - self.u(f"{tag}:r"))) * F.cos(2 * np.pi * self.u(f"{tag}:a"))

    def centres(self) -> tuple[DataFrame, DataFrame]:
        """The rows with their cluster's place, and (dataset, centres, size): the clusters' means in order."""
        c = space.kmeans(self.rows.select("dataset", "row_id", F.array(*self.features).alias("z")), 20, share=40).select("dataset", "row_id", "cluster")
        c = stored(self.rows.join(c, ["dataset", "row_id"]), "clustered")
        means = c.groupBy("dataset", "cluster").agg(F.array(*[F.avg(f) for f in self.features]).alias("c"))
        listed = means.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("_l"))  # 20 at most
        listed = stored(listed.select("dataset", F.transform("_l", lambda x: x["cluster"]).alias("names"), F.transform("_l", lambda x: x["c"]).alias("centres"), F.size("_l").alias("size")), "centres")
        return c.join(listed.select("dataset", "names"), "dataset").withColumn("place", F.array_position("names", F.col("cluster")) - 1).drop("names", "cluster"), listed

    def back(self, points: DataFrame, first: int | None = None) -> DataFrame:
        """(dataset, k, level, features) in the normals' units; the ``first`` of each data set by k, numbered anew."""
        if first is not None:
            points = points.withColumn("k", F.row_number().over(W.partitionBy("dataset").orderBy("k")) - 1).where(F.col("k") < first)
        own = [(F.col(f) * F.col(f"_{f}.s") + F.col(f"_{f}.m")).alias(f) for f in self.features]
        return points.join(self.stats, "dataset").select("dataset", F.col("k").cast("bigint").alias("k"), F.col("level").cast("double").alias("level"), *own)


def between_centres(normals: DataFrame, features: tuple[str, ...], n: int, seed: object) -> DataFrame:
    """(dataset, k, level, features): rows moved a share of 0.5 to 1.3 of the way to the centre of another cluster."""
    x = _Space(normals, features, n, seed)
    rows, listed = x.centres()
    p = _joined(rows, draws(rows, n, seed, 0), (*features, "place"), 0).join(listed, "dataset")
    other = (F.col("place") + 1 + F.floor(x.u("to") * F.greatest(F.lit(1), F.col("size") - 1))) % F.col("size")
    p = p.withColumn("_c", F.col("centres")[other.cast("int")]).withColumn("_t", 0.5 + 0.8 * x.u("way"))
    return x.back(p.select("dataset", "k", F.lit(None).cast("double").alias("level"), *[(F.col(f) + F.col("_t") * (F.col("_c")[i] - F.col(f))).alias(f) for i, f in enumerate(features)]))


def density_band(normals: DataFrame, features: tuple[str, ...], n: int, seed: object) -> DataFrame:
    """(dataset, k, level, features): noisy points between two centres whose distance to the 10th row lies in the normals' own
    60-95 % band (a normal counts itself). At most ``n`` of 12 n candidates; all normals take part."""
    x = _Space(normals, features, n, seed)
    listed = x.centres()[1]
    c = listed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(12 * n - 1))))
    i = F.floor(x.u("from") * F.col("size"))
    j = (F.col("_i") + 1 + F.floor(x.u("to") * F.greatest(F.lit(1), F.col("size") - 1))) % F.col("size")
    c = c.withColumn("_i", i.cast("int")).withColumn("_j", j.cast("int")).withColumn("_t", 0.35 + 0.3 * x.u("way"))
    at = lambda m: F.col("_t") * F.col("centres")[F.col("_i")][m] + (1 - F.col("_t")) * F.col("centres")[F.col("_j")][m]
    p = stored(c.select("dataset", "k", (-F.col("k") - 1).cast("bigint").alias("row_id"), *[(at(m) + 0.15 * x.gauss(f)).alias(f) for m, f in enumerate(features)]), "candidates")
    tree = CellTree.build(x.rows, features, 10)
    own = tree.search(x.rows, 9).where("place = 9").groupBy("dataset").agg(F.percentile("distance", 0.6).alias("_lo"), F.percentile("distance", 0.95).alias("_hi"))
    far = tree.search(p, 10).where("place = 10").select("dataset", "row_id", F.col("distance").alias("_d"))
    kept = p.join(far, ["dataset", "row_id"]).join(own, "dataset").where("_d >= _lo AND _d <= _hi")
    return x.back(kept.withColumn("level", F.lit(None).cast("double")), n)


def valley(normals: DataFrame, features: tuple[str, ...], n: int, seed: object, k: int = 10, reach: float = 1.6, alpha: float = 0.6) -> DataFrame:
    """(dataset, k, level, features): the least dense of eight points on a segment from a row to a neighbourhood that is not its own,
    if its density is under ``alpha`` times that of either end; the level is how many times less dense it is.

    A row's neighbourhood is its ``k`` nearest; a step of ``reach`` times its radius in a hash-drawn direction leads to the tip,
    and the other end is the nearest to it of the tip's ``k`` nearest rows outside the neighbourhood. Density is one over the
    mean distance of the ``k`` nearest. At most ``n`` of 40 n draws; every lookup is a batch over all normals.
    """
    x = _Space(normals, features, n, seed)
    tree = CellTree.build(x.rows, features, k)
    near = tree.search(x.rows, k).groupBy("dataset", "row_id").agg(F.max("distance").alias("radius"), (1 / (F.avg("distance") + 1e-9)).alias("density"))
    own = stored(x.rows.join(near, ["dataset", "row_id"]), "densities")
    a = _joined(own, draws(own, 40 * n, seed, 0), (*features, "radius", "density"), 0)
    a = a.withColumn("_u", F.array(*[x.gauss(f) for f in features]))
    size = F.sqrt(F.aggregate("_u", F.lit(0.0), lambda s, v: s + v * v)) + 1e-12
    tips = a.select("dataset", "k", (-F.col("k") - 1).alias("row_id"), *[F.col(f).alias(f"_a_{f}") for f in features], "radius", F.col("density").alias("_da"), *[(F.col(f) + reach * F.col("radius") * F.col("_u")[m] / size).alias(f) for m, f in enumerate(features)])
    tips = stored(tips, "tips")
    ends = own.select("dataset", F.col("row_id").alias("other"), *[F.col(f).alias(f"_b_{f}") for f in features], F.col("density").alias("_db"))
    met = tree.search(tips, k).select("dataset", "row_id", "other", "distance").join(ends, ["dataset", "other"]).join(tips, ["dataset", "row_id"])
    apart = sum(((F.col(f"_b_{f}") - F.col(f"_a_{f}")) ** 2 for f in features), F.lit(0.0))
    met = met.where(apart > F.col("radius") ** 2)
    best = met.withColumn("_o", F.row_number().over(W.partitionBy("dataset", "k").orderBy("distance", "other"))).where("_o = 1")
    step = F.posexplode(F.array(*[F.lit(0.15 + 0.1 * j) for j in range(8)])).alias("_j", "_t")
    path = best.select("dataset", "k", "_da", "_db", *[f"_{e}_{f}" for e in "ab" for f in features], step)
    path = stored(path.select("dataset", "k", "_da", "_db", (-8 * F.col("k") - F.col("_j") - 1).alias("row_id"), *[((1 - F.col("_t")) * F.col(f"_a_{f}") + F.col("_t") * F.col(f"_b_{f}")).alias(f) for f in features]), "paths")
    rho = tree.search(path, k).groupBy("dataset", "row_id").agg((1 / (F.avg("distance") + 1e-9)).alias("_r"))
    deep = path.join(rho, ["dataset", "row_id"]).groupBy("dataset", "k").agg(F.min_by(F.struct(*features), F.struct(F.col("_r"), -F.col("row_id"))).alias("p"), F.min("_r").alias("_r"), F.first("_da").alias("_da"), F.first("_db").alias("_db"))
    least = F.least("_da", "_db")
    kept = deep.where(F.col("_r") < alpha * least).select("dataset", "k", (least / F.col("_r")).alias("level"), "p.*")
    return x.back(kept, n)


WHOLE = {f.__name__: f for f in (between_centres, density_band, valley)}


def geometric(normals: DataFrame, features: tuple[str, ...], n: int, seed: int, kind: str) -> DataFrame:
    """(dataset, k, level, features) of the generators that follow geometry: between_centres, density_band, level_set, void or
    valley. Points that miss a generator's condition are left out, so there may be fewer than ``n`` (level_set: ``n`` walks).

    between_centres, density_band and valley know all normals. level_set and void follow a kernel density over at most
    ``REFERENCE`` normals of a data set, in MD5 order, as their definitions have it, so a data set's group is bounded.
    """
    if kind in WHOLE:
        return WHOLE[kind](normals, features, n, seed)
    place = F.row_number().over(W.partitionBy("dataset").orderBy(F.md5(F.col("row_id").cast("string"))))
    few = normals.select("dataset", "row_id", *features).withColumn("_k", place).where(F.col("_k") <= REFERENCE)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("row_id")[list(features)].to_numpy(float)
        mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
        p, level = SAMPLED[kind]((x - mean) / sd, n, np.random.default_rng(seed)) if len(x) > 12 else (x[:0], np.zeros(0))
        back = p * sd + mean
        return pd.DataFrame({"dataset": pdf["dataset"].iloc[0], "k": np.arange(len(back)), "level": level, **{f: back[:, c] for c, f in enumerate(features)}})

    return few.groupBy("dataset").applyInPandas(run, "dataset string, k long, level double, " + ", ".join(f"{f} double" for f in features))
