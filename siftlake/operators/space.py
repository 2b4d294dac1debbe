"""Embedding, clustering and neighbours of tabular rows (dataset, row_id, features)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions.ranks import min_max
from siftlake.operators.spatial import CellTree


def standardise(rows: DataFrame, features: tuple[str, ...], train: DataFrame | None = None) -> DataFrame:
    """rows with each feature at zero mean and unit population deviation of ``train`` (or of the rows) within its data set;
    constants become 0."""
    stats = (rows if train is None else train).groupBy("dataset").agg(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f"_{f}") for f in features])
    out = {f: F.coalesce(F.try_divide(F.col(f) - F.col(f"_{f}.m"), F.col(f"_{f}.s")), F.lit(0.0)) for f in features}
    return rows.join(stats, "dataset").withColumns(out).select(*rows.columns)


def gram(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(dataset, n, means, gram): sums and products of features, one partial aggregation whatever the number of rows."""
    sums = [F.avg(f) for f in features]
    products = [F.avg(F.col(a) * F.col(b)) for i, a in enumerate(features) for b in features[i:]]
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("means"), F.array(*products).alias("gram"))


def covariance(means: list[float], products: list[float]) -> np.ndarray:
    d = len(means)
    c = np.zeros((d, d))
    c[np.triu_indices(d)] = products
    c = c + c.T - np.diag(np.diag(c))
    return c - np.outer(means, means)


def principal_axes(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(dataset, means, values, axes): eigenvalues, largest first, and unit axes; each axis's largest entry is positive."""

    @F.pandas_udf("struct<values:array<double>,axes:array<array<double>>>")
    def eigen(means: pd.Series, products: pd.Series) -> pd.DataFrame:
        values, axes = [], []
        for m, p in zip(means, products, strict=True):
            w, v = np.linalg.eigh(covariance(list(m), list(p)))
            w, v = w[::-1], v[:, ::-1].T
            v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
            values.append(np.maximum(w, 0).tolist())
            axes.append(v.tolist())
        return pd.DataFrame({"values": values, "axes": axes})

    return gram(rows, features).select("dataset", "n", "means", eigen("means", "gram").alias("e")).select("dataset", "n", "means", "e.values", "e.axes")


def embed(rows: DataFrame, features: tuple[str, ...], dim: int = 16, train: DataFrame | None = None) -> DataFrame:
    """rows with z: the standardised features, or their first ``dim`` principal coordinates if there are more, by ``train``."""
    z = standardise(rows, features, train)
    if len(features) <= dim:
        return z.withColumn("z", F.array(*features))
    axes = principal_axes(z if train is None else standardise(train, features), features).select("dataset", F.slice("axes", 1, dim).alias("axes"))
    x = z.join(axes, "dataset").withColumn("_x", F.array(*features))
    return x.withColumn("z", F.expr("transform(axes, a -> aggregate(zip_with(a, _x, (u, v) -> u * v), 0.0D, (s, t) -> s + t))")).drop("axes", "_x")


def random_projection(rows: DataFrame, features: tuple[str, ...], dim: int, seed: int = 0) -> DataFrame:
    """rows with z: ``dim`` Gaussian projections of the features, the same for a seed."""
    m = np.random.default_rng(seed).normal(size=(dim, len(features))) / np.sqrt(dim)
    return rows.withColumn("z", F.array(*[sum((F.lit(float(w)) * F.col(f) for w, f in zip(row, features, strict=True)), F.lit(0.0)) for row in m]))


LANDMARKS = 1500  #: rows of a data set that the kernel's axes are found on, as the definition has it
PART = 20_000  #: rows of a data set projected in one group


def kernel_projection(rows: DataFrame, features: tuple[str, ...], dim: int = 16, seed: object = 0) -> DataFrame:
    """rows with z: coordinates on the first min(``dim``, features) axes of a Gaussian kernel of width 1 / features, of the
    standardised rows.

    The axes are those of the centred kernel matrix of ``LANDMARKS`` hash-drawn rows of a data set; every row is projected by
    its kernel values to these, in parts of bounded size that meet their data set's axes in a cogroup. An axis points to the
    side of its largest coefficient.
    """
    names, d = list(features), len(features)
    z = standardise(rows.select("dataset", "row_id", *[F.col(f).cast("double").alias(f) for f in names]).dropna(), features)
    place = F.row_number().over(W.partitionBy("dataset").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_id").cast("string")))))
    few = z.withColumn("_k", place).where(F.col("_k") <= LANDMARKS)

    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.exp(-np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1), 0) / d)

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        x = df.sort_values("_k")[names].to_numpy(float)
        k = kernel(x, x)
        mean = k.mean(axis=0)
        w, v = np.linalg.eigh(k - mean[None] - mean[:, None] + mean.mean())
        w, v = w[::-1][: min(dim, d)], v[:, ::-1][:, : min(dim, d)]
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        axes = v / np.sqrt(np.maximum(w, 1e-12))
        return pd.DataFrame({"dataset": [df["dataset"].iloc[0]], "x": [x.ravel().tolist()], "axes": [axes.ravel().tolist()], "mean": [mean.tolist()]})

    models = few.groupBy("dataset").applyInPandas(fit, "dataset string, x array<double>, axes array<double>, mean array<double>")
    parts = z.groupBy("dataset").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts"))
    dealt = z.join(parts, "dataset").withColumn("_part", F.pmod(F.xxhash64("row_id"), F.col("_parts")).cast("int")).drop("_parts")
    models = models.join(parts, "dataset").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    def project(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"dataset": [], "row_id": [], "z": []})
        mean = np.asarray(model["mean"].iloc[0])
        x, axes = np.asarray(model["x"].iloc[0]).reshape(len(mean), -1), np.asarray(model["axes"].iloc[0]).reshape(len(mean), -1)
        k = kernel(own[names].to_numpy(float), x)
        k = k - k.mean(axis=1, keepdims=True) - mean + mean.mean()
        return pd.DataFrame({"dataset": own["dataset"], "row_id": own["row_id"], "z": (k @ axes).tolist()})

    met = dealt.groupBy("dataset", "_part").cogroup(models.groupBy("dataset", "_part"))
    return met.applyInPandas(project, "dataset string, row_id long, z array<double>")


def separation(rows: DataFrame) -> DataFrame:
    """(dataset, calinski, davies) of rows (dataset, z, cluster): the ratio of the spread between to that within clusters, each over
    its degrees of freedom, and the negated mean, over clusters, of the largest sum of two mean distances to the own centre over
    the centres' distance. From sums by cluster; pairs are of clusters only."""
    d = rows.select("dataset", "cluster", F.posexplode("z").alias("i", "v"))
    sums = d.groupBy("dataset", "cluster", "i").agg(F.avg("v").alias("m"), F.var_pop("v").alias("v"), F.count(F.lit(1)).alias("n"))
    total = d.groupBy("dataset", "i").agg(F.avg("v").alias("all"))
    spread = sums.join(total, ["dataset", "i"]).groupBy("dataset").agg(F.sum(F.col("n") * F.col("v")).alias("w"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("all"), 2)).alias("b"))
    sizes = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("k"))
    calinski = F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k")))
    ratio = spread.join(sizes.where("k > 1"), "dataset").select("dataset", calinski.alias("calinski"))
    centre = sums.groupBy("dataset", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    own = rows.join(centre, ["dataset", "cluster"]).groupBy("dataset", "cluster").agg(F.avg(_distance("z", "c")).alias("s")).join(centre, ["dataset", "cluster"])
    other = own.select("dataset", F.col("cluster").alias("_o"), F.col("s").alias("_s"), F.col("c").alias("_c"))
    pairs = own.join(other, "dataset").where("cluster <> _o")
    worst = pairs.groupBy("dataset", "cluster").agg(F.max(F.try_divide(F.col("s") + F.col("_s"), _distance("c", "_c"))).alias("r"))
    return ratio.join(worst.groupBy("dataset").agg((-F.avg("r")).alias("davies")), "dataset")


def kmeans(rows: DataFrame, k: int, seed: int = 0, sample: int = 5000, rounds: int = 15, train: DataFrame | None = None, share: int = 20) -> DataFrame:
    """rows (dataset, row_id, z) with cluster: k-means++ and Lloyd on a capped MD5 sample of ``train`` (or of the rows), then
    each row's nearest centre.

    min(k, max(2, n // share)) clusters. Centres are fitted for each data set on at most ``sample`` rows; every row is
    assigned by a join with them.
    """
    place = F.row_number().over(W.partitionBy("dataset").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_id").cast("string")))))
    n = F.count(F.lit(1)).over(W.partitionBy("dataset"))
    few = (rows if train is None else train).select("dataset", "row_id", "z").withColumn("_n", n).withColumn("_k", place).where(F.col("_k") <= sample)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        x = np.stack(pdf["z"].to_numpy()).astype(float)
        kk = min(k, max(2, int(pdf["_n"].iloc[0]) // share), len(x))
        rng = np.random.default_rng(seed)
        centres = [x[0]]
        for _ in range(kk - 1):
            d = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2).min(axis=1)
            centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        c = np.array(centres)
        for _ in range(rounds):
            near = ((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)).argmin(axis=1)
            c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(kk)])
        return pd.DataFrame({"dataset": [pdf["dataset"].iloc[0]], "centres": [c.tolist()]})

    centres = few.groupBy("dataset").applyInPandas(fit, "dataset string, centres array<array<double>>")
    near = F.expr("array_min(transform(centres, (c, i) -> struct(aggregate(zip_with(c, z, (a, b) -> (a - b) * (a - b)), 0.0D, (s, t) -> s + t) AS d, i AS i))).i")
    return rows.join(centres, "dataset").withColumn("cluster", near.cast("int")).drop("centres")


def _distance(a: str, b: str) -> Column:
    return F.expr(f"sqrt(aggregate(zip_with({a}, {b}, (u, v) -> (u - v) * (u - v)), 0.0D, (s, t) -> s + t))")


def composite_scores(rows: DataFrame) -> DataFrame:
    """(dataset, cluster, size, size_component, far_component, density_component, composite) of rows (dataset, z, cluster).

    Centres are averages by coordinate; each centre meets the others of its data set (tens of rows).
    """
    d = rows.select("dataset", "cluster", F.posexplode("z").alias("i", "v")).groupBy("dataset", "cluster", "i").agg(F.avg("v").alias("m"))
    centre = d.groupBy("dataset", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    inner = rows.join(centre, ["dataset", "cluster"]).groupBy("dataset", "cluster").agg(F.count(F.lit(1)).alias("size"), F.avg(_distance("z", "c")).alias("density"))
    a = centre.select("dataset", F.col("cluster").alias("_o"), F.col("c").alias("_c"))
    far = centre.join(a, "dataset").where("cluster <> _o").withColumn("_d", _distance("c", "_c"))
    far = far.withColumn("_k", F.row_number().over(W.partitionBy("dataset", "cluster").orderBy("_d", "_o"))).where("_k <= 3").groupBy("dataset", "cluster").agg(F.avg("_d").alias("far"))
    s = inner.join(far, ["dataset", "cluster"], "left")
    share = 1 - F.col("size") / F.sum("size").over(W.partitionBy("dataset"))
    s = s.withColumn("_s", share).withColumn("far", F.coalesce("far", F.lit(0.0)))
    s = s.select("dataset", "cluster", "size", min_max(["dataset"], F.col("_s")).alias("size_component"), min_max(["dataset"], F.col("far")).alias("far_component"), min_max(["dataset"], F.col("density")).alias("density_component"))
    return s.withColumn("composite", (F.col("size_component") + F.col("far_component") + F.col("density_component")) / 3)


def effective_clusters(rows: DataFrame, least: int = 3) -> DataFrame:
    """(dataset, n_clusters, use_mixture): a mixture is used if it keeps at least ``least`` clusters."""
    return rows.groupBy("dataset").agg(F.countDistinct("cluster").alias("n_clusters")).withColumn("use_mixture", F.col("n_clusters") >= least)


def mixture(rows: DataFrame, k: int = 4, rounds: int = 25, seed: int = 0, sample: int = 5000) -> DataFrame:
    """rows with cluster: the most likely component of a diagonal Gaussian mixture, fitted on a capped sample."""
    start = kmeans(rows, k, seed, sample, rounds=5)
    place = F.row_number().over(W.partitionBy("dataset").orderBy(F.md5(F.col("row_id").cast("string"))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["z"].to_numpy()).astype(float)
        r = np.eye(int(pdf["cluster"].max()) + 1)[pdf["cluster"].to_numpy()]
        for _ in range(rounds):
            n = r.sum(axis=0) + 1e-9
            m = (r.T @ x) / n[:, None]
            v = (r.T @ x**2) / n[:, None] - m**2 + 1e-6
            log = np.log(n / n.sum()) - 0.5 * (np.log(v).sum(axis=1) + ((x[:, None] - m) ** 2 / v).sum(axis=2))
            r = np.exp(log - log.max(axis=1, keepdims=True))
            r /= r.sum(axis=1, keepdims=True)
        parts = [{"w": float(np.log(a / n.sum()) - 0.5 * np.log(c).sum()), "m": b.tolist(), "v": c.tolist()} for a, b, c in zip(n, m, v, strict=True)]
        return pd.DataFrame({"dataset": [pdf["dataset"].iloc[0]], "parts": [parts]})

    few = start.withColumn("_k", place).where(F.col("_k") <= sample).select("dataset", "z", "cluster")
    parts = few.groupBy("dataset").applyInPandas(fit, "dataset string, parts array<struct<w:double,m:array<double>,v:array<double>>>")
    best = F.expr("array_max(transform(parts, (p, i) -> struct(p.w - 0.5D * aggregate(zip_with(zip_with(p.m, z, (a, b) -> (a - b) * (a - b)), p.v, (q, v) -> q / v), 0.0D, (s, t) -> s + t) AS l, -i AS i))).i")
    return rows.join(parts, "dataset").withColumn("cluster", (-best).cast("int")).drop("parts")


def neighbours(queries: DataFrame, reference: DataFrame, features: tuple[str, ...], k: int) -> DataFrame:
    """(dataset, row_id, other, distance, place): the ``k`` nearest reference rows of each query, itself excluded; equal
    distances go by the smaller id. Exact, from a stored tree of cells (``spatial.CellTree``)."""
    return CellTree.build(reference, features, k).search(queries, k)
