"""Label-free descriptions of a data set's structure, and of where its anomalies lie."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.operators import metrics as M
from siftlake.operators import space
from siftlake.session import stored

BLOCK = 8192  #: points of a block that a task compares with another


def moments(long: DataFrame) -> DataFrame:
    """(dataset, mean_skew, mean_kurt, kurt_max, heavy_share, bimodal_share) over features that vary.

    heavy_share counts excess kurtosis above 3; bimodal_share a coefficient above 0.555, which is (skew² + 1) / (kurtosis +
    3 (n - 1)² / ((n - 2) (n - 3))).
    """
    m = long.groupBy("dataset", "feature").agg(F.skewness("value").alias("s"), F.kurtosis("value").alias("k"), F.count("value").cast("double").alias("n"), F.stddev_pop("value").alias("sd")).where("sd >= 1e-9")
    coefficient = F.expr("(s * s + 1) / (k + 3 * (n - 1) * (n - 1) / greatest((n - 2) * (n - 3), 1))")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return m.groupBy("dataset").agg(F.avg(F.abs("s")).alias("mean_skew"), F.avg("k").alias("mean_kurt"), F.max("k").alias("kurt_max"), share(F.col("k") > 3).alias("heavy_share"), share(coefficient > 0.555).alias("bimodal_share"))


def extent(rows: DataFrame, features: tuple[str, ...], clusters: int = 10) -> DataFrame:
    """(dataset, tail_ratio, cluster_gain, log_n, log_d) of standardised rows: the 99th percentile of distances to the centre
    over their median; what k-means with min(clusters, max(2, n // 50)) centres takes off the sum of squares; sizes as log10."""
    z = stored(space.standardise(rows.select("dataset", "row_id", *features), features).withColumn("z", F.array(*features)), "standard")
    square = F.expr("aggregate(z, 0.0D, (s, x) -> s + x * x)")
    far = z.groupBy("dataset").agg((F.percentile(F.sqrt(square), 0.99) / (F.percentile(F.sqrt(square), 0.5) + 1e-9)).alias("tail_ratio"), F.sum(square).alias("_all"), F.log10(F.count(F.lit(1))).alias("log_n"))
    c = space.kmeans(z.select("dataset", "row_id", "z"), clusters, share=50)
    sums = c.select("dataset", "cluster", F.posexplode("z").alias("i", "v")).groupBy("dataset", "cluster", "i").agg((F.var_pop("v") * F.count(F.lit(1))).alias("_w"))
    within = sums.groupBy("dataset").agg(F.sum("_w").alias("_within"))
    return far.join(within, "dataset").select("dataset", "tail_ratio", (1 - F.col("_within") / (F.col("_all") + 1e-9)).alias("cluster_gain"), "log_n", F.log10(F.lit(float(len(features)))).alias("log_d"))


def mean_correlation(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(dataset, mean_abs_corr) over pairs of features, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    total = sum((F.coalesce(F.abs(F.corr(a, b)), F.lit(0.0)) for a, b in pairs), F.lit(0.0))
    return rows.groupBy("dataset").agg((total / len(pairs)).alias("mean_abs_corr"))


def spectrum(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(dataset, effective_dim, top_share, low_share, intrinsic_95, eigengap) of the standardised covariance; low_share is
    that of the lower half of the axes."""
    e = space.principal_axes(space.standardise(rows, features), features)
    total = "aggregate(values, 0.0D, (s, x) -> s + x)"
    upto = "transform(values, (v, i) -> aggregate(slice(values, 1, i + 1), 0.0D, (s, x) -> s + x))"
    return e.select(
        "dataset",
        F.expr(f"{total} * {total} / aggregate(values, 0.0D, (s, x) -> s + x * x)").alias("effective_dim"),
        F.expr(f"values[0] / {total}").alias("top_share"),
        F.expr(f"aggregate(slice(values, size(values) div 2 + 1, size(values)), 0.0D, (s, x) -> s + x) / {total}").alias("low_share"),
        F.expr(f"1 + size(filter({upto}, c -> c < 0.95 * {total} - 1e-12))").alias("intrinsic_95"),
        F.expr(f"(values[0] - values[1]) / {total}").alias("eigengap"),
    )


def neighbour_structure(rows: DataFrame, features: tuple[str, ...], k: int = 5) -> DataFrame:
    """(dataset, nn_scale, density_spread, nn_ratio, two_nn_dim, hubness) of standardised rows, each among all others.

    Of the nearest distances: median, deviation over mean, 90th over 10th percentile. two_nn_dim is the intrinsic dimension by
    the ratios of second to first distance above 1 (the number of features if there are five or fewer). hubness is the
    skewness, over rows, of how often a row is among the ``k`` nearest of others.
    """
    z = stored(space.standardise(rows.select("dataset", "row_id", *features), features), "standard")
    n = stored(space.neighbours(z, z, features, k), "neighbours")
    first, second = (F.max(F.when(F.col("place") == p, F.col("distance"))) for p in (1, 2))
    near = n.groupBy("dataset", "row_id").agg(first.alias("d1"), second.alias("d2")).withColumn("mu", F.col("d2") / (F.col("d1") + 1e-12))
    ratio = F.when(F.col("mu") > 1, F.ln("mu"))
    dimension = F.when(F.count(ratio) > 5, F.count(ratio) / (F.sum(ratio) + 1e-9)).otherwise(F.lit(float(len(features))))
    g = near.groupBy("dataset").agg(
        F.percentile("d1", 0.5).alias("nn_scale"),
        (F.stddev_pop("d1") / (F.avg("d1") + 1e-9)).alias("density_spread"),
        (F.percentile("d1", 0.9) / (F.percentile("d1", 0.1) + 1e-9)).alias("nn_ratio"),
        dimension.alias("two_nn_dim"),
    )
    hubs = n.groupBy("dataset", F.col("other").alias("row_id")).agg(F.count(F.lit(1)).alias("c"))
    hubs = z.select("dataset", "row_id").join(hubs, ["dataset", "row_id"], "left").groupBy("dataset").agg(F.skewness(F.coalesce("c", F.lit(0))).alias("hubness"))
    return g.join(hubs, "dataset")


def silhouette(asked: DataFrame, features: tuple[str, ...], rows: DataFrame | None = None) -> DataFrame:
    """(dataset, silhouette) of the asked rows among ``rows`` (or themselves): mean of (b - a) / max(a, b) over rows of clusters
    of two or more.

    Equal vectors of a cluster are one point with a count. Points are dealt to blocks of ``BLOCK`` asked and other points, and a
    task adds up the distances of two blocks, so pairs are no rows; a row is at no distance from itself and is not counted.
    """
    names = list(features)
    key = ["dataset", "cluster", *names]
    rows = asked if rows is None else rows
    keyed = lambda df: df.select("dataset", "row_id", "cluster", *[F.col(f).cast("double").alias(f) for f in names]).dropna()
    points = stored(keyed(rows).groupBy(*key).agg(F.count(F.lit(1)).alias("c")), "points")
    own = stored(keyed(asked).join(rows.select("dataset", "row_id", F.lit(1).alias("_in")), ["dataset", "row_id"], "left"), "asked")
    at = stored(own.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.count("_in").alias("_in")).withColumn("_p", F.monotonically_increasing_id()), "asked-points")
    dealt = lambda df, k, n: df.withColumn(k, F.pmod(F.xxhash64(*key[1:]), n))
    sizes = points.groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_m")).join(at.groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_n")), "dataset")
    x = dealt(at.join(sizes, "dataset"), "_i", F.col("_n")).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1)))
    o = dealt(points.join(sizes, "dataset"), "_j", F.col("_m")).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    x, o = x.select("dataset", "_i", "_j", "_p", *names), o.select("dataset", "_i", "_j", F.col("cluster").alias("_c"), "c", *names)

    def added(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"_p": [], "_c": [], "s": []})
        b = b.sort_values("_c")
        first = np.flatnonzero(np.concatenate([[True], b["_c"].to_numpy()[1:] != b["_c"].to_numpy()[:-1]]))
        u, v, c = a[names].to_numpy(float), b[names].to_numpy(float), b["c"].to_numpy(float)
        s = np.concatenate([np.add.reduceat(np.sqrt(sum((u[k : k + 128, f][:, None] - v[:, f][None]) ** 2 for f in range(len(names)))) * c, first, axis=1) for k in range(0, len(u), 128)])
        return pd.DataFrame({"_p": np.repeat(a["_p"].to_numpy(), len(first)), "_c": np.tile(b["_c"].to_numpy()[first], len(u)), "s": s.ravel()})

    kind = rows.schema["cluster"].dataType.simpleString()
    met = x.groupBy("dataset", "_i", "_j").cogroup(o.groupBy("dataset", "_i", "_j")).applyInPandas(added, f"_p bigint, _c {kind}, s double")
    far = met.groupBy("_p", "_c").agg(F.sum("s").alias("s")).join(at.select("_p", "dataset", "cluster"), "_p")
    counts = points.groupBy("dataset", F.col("cluster").alias("_c")).agg(F.sum("c").alias("_n"))
    # of the own cluster a row among ``rows`` counts one less
    m = far.join(counts, ["dataset", "_c"])
    for known, less in ((True, 1), (False, 0)):
        n = F.col("_n") - F.when(F.col("cluster") == F.col("_c"), less).otherwise(0)
        part = m.withColumn("m", F.when(n > 0, F.col("s") / n)).groupBy("_p").agg(F.min(F.when(F.col("cluster") == F.col("_c"), F.col("m"))).alias("a"), F.min(F.when(F.col("cluster") != F.col("_c"), F.col("m"))).alias("b"))
        both = part.withColumn("known", F.lit(known)) if known else both.unionByName(part.withColumn("known", F.lit(known)))
    value = (F.col("b") - F.col("a")) / (F.greatest("a", "b") + 1e-12)
    weight = F.when(F.col("known"), F.col("_in")).otherwise(F.col("c") - F.col("_in"))
    ab = both.where("a IS NOT NULL AND b IS NOT NULL").join(at.select("_p", "dataset", "c", "_in"), "_p").withColumn("_w", weight).where("_w > 0")
    return ab.groupBy("dataset").agg((F.sum(value * F.col("_w")) / F.sum("_w")).alias("silhouette"))


def placement(rows: DataFrame, features: tuple[str, ...], k: int = 5, asked: DataFrame | None = None) -> DataFrame:
    """(dataset, row_id, place) of the asked anomalies (or all), the cut being that of the asked normals: outside the normals' 1-99% box, inside-far from any normal, or embedded."""
    q = rows.where("y = 0").groupBy("dataset").agg(*[F.percentile(f, F.array(F.lit(0.01), F.lit(0.99))).alias(f"_{f}") for f in features])
    out = F.lit(False)
    for f in features:
        out = out | (F.col(f) < F.col(f"_{f}")[0]) | (F.col(f) > F.col(f"_{f}")[1])
    normal = rows.where("y = 0")
    asked = rows if asked is None else asked
    d = space.neighbours(asked, normal, features, k).groupBy("dataset", "row_id").agg(F.max("distance").alias("d"))
    d = asked.select("dataset", "row_id", "y", *features).join(d, ["dataset", "row_id"]).join(q, "dataset").withColumn("_o", out)
    cut = d.where("y = 0").groupBy("dataset").agg(F.percentile("d", 0.95).alias("_c"))
    return d.where("y = 1").join(cut, "dataset").select("dataset", "row_id", F.when(F.col("_o"), "outside").when(F.col("d") > F.col("_c"), "inside_far").otherwise("embedded").alias("place"))


def anomaly_geometry(rows: DataFrame, features: tuple[str, ...], k: int = 10, asked: DataFrame | None = None) -> DataFrame:
    """(dataset, row_id, radial, density, normal_share, extremity, kind) of the asked anomalies (or all) among all rows.

    radial and density are shares of the asked normals nearer the mean and in denser places; normal_share is the share of normals
    among the neighbours; extremity the largest absolute z-score.
    """
    from siftlake.operators.detectors import max_z
    from siftlake.operators.select import share_below

    asked = rows if asked is None else asked
    n = space.neighbours(asked, rows, features, k)
    y = rows.select("dataset", F.col("row_id").alias("other"), (1 - F.col("y")).alias("_n"))
    near = n.join(y, ["dataset", "other"]).groupBy("dataset", "row_id").agg(F.avg("_n").alias("normal_share"), F.round(F.max("distance"), 9).alias("d"))
    stats = rows.where("y = 0").groupBy("dataset").agg(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f"_{f}") for f in features])
    r = F.sqrt(sum((F.pow((F.col(f) - F.col(f"_{f}.m")) / (F.col(f"_{f}.s") + 1e-9), 2) for f in features), F.lit(0.0)))
    base = asked.join(stats, "dataset").select("dataset", "row_id", "y", F.round(r, 9).alias("r")).join(near, ["dataset", "row_id"]).join(max_z(asked, features, train=rows.where("y = 0")).withColumnRenamed("score", "extremity"), ["dataset", "row_id"])
    shares = []
    for name, c in (("radial", "r"), ("density", "d")):
        s = base.select("dataset", "row_id", "y", F.col(c).alias("score"))
        shares.append(share_below(s.where("y = 1"), s.where("y = 0"), ["dataset"]).withColumnRenamed("share", name))
    g = base.where("y = 1").join(shares[0], ["dataset", "row_id"]).join(shares[1], ["dataset", "row_id"])
    kind = F.when((F.col("radial") > 0.95) & (F.col("density") > 0.95), "outside").when(F.col("radial") > 0.95, "edge").when(F.col("density") > 0.95, "between").otherwise("inside")
    return g.select("dataset", "row_id", "radial", "density", "normal_share", "extremity", kind.alias("kind"))


def signature(synthetic: DataFrame, normals: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(dataset, top_share, effective_features): how the deviation of anomalies is spread over features."""
    s = normals.groupBy("dataset").agg(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f"_{f}") for f in features])
    z = F.array(*[F.pow((F.col(f) - F.col(f"_{f}.m")) / (F.col(f"_{f}.s") + 1e-9), 2) for f in features])
    d = synthetic.join(s, "dataset").withColumn("_z", z).withColumn("_t", F.expr("aggregate(_z, 0.0D, (a, x) -> a + x)")).where("_t > 0")
    return d.groupBy("dataset").agg(F.avg(F.expr("array_max(_z) / _t")).alias("top_share"), F.avg(F.expr("_t * _t / aggregate(_z, 0.0D, (a, x) -> a + x * x)")).alias("effective_features"))


def best_feature_against_best_detector(long: DataFrame, scores: DataFrame) -> DataFrame:
    """(dataset, best_single, best_multi): the best AUC of a feature, either direction, and of a detector."""
    one = M.roc_auc(long.withColumnRenamed("value", "score"), ["dataset", "feature"]).groupBy("dataset").agg(F.max(F.greatest("auc", 1 - F.col("auc"))).alias("best_single"))
    return one.join(M.roc_auc(scores, ["dataset", "detector"]).groupBy("dataset").agg(F.max("auc").alias("best_multi")), "dataset")
