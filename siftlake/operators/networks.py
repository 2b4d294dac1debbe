"""Autoencoders of tabular rows: one small network a data set, fitted in rounds over all of its rows.

A network is d - h - dim - h - d with rectified hidden layers, over standardised features. Rows are dealt by hash to blocks of about
``BLOCK``, written once. In a round each block takes ``STEPS`` steps of Adam on its own batches from the common weights, and
the next weights are the mean of the blocks', by rows: a task adds its blocks up, so that what is shuffled is a network for each
(task, data set) and does not grow with the rows. Networks of at most ``SETS`` data sets are broadcast at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructField, StructType

from siftlake.operators.mixtures import fit as fit_mixture
from siftlake.operators.synth import shuffle_features
from siftlake.session import stored

BLOCK = 1024  #: rows of a block, on average
BATCH = 128  #: rows of a step
STEPS = 32  #: steps of a block in a round
SETS = 256  #: data sets whose networks are broadcast at a time
OVERSAMPLE = 12  #: candidates for each synthetic row that is asked for


@dataclass(frozen=True)
class Network:
    """Weights in one vector, in the order of the layers, a layer's matrix before its offsets."""

    sizes: tuple[int, ...]
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.deviation

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Latent coordinates of raw rows."""
        return forward(self.scaled(x), layers(self.weights, self.sizes))[2]

    def errors(self, x: np.ndarray) -> np.ndarray:
        """Distance of each raw row from what the network makes of it, in deviations."""
        z = self.scaled(x)
        return np.linalg.norm(z - forward(z, layers(self.weights, self.sizes))[4], axis=1)


def shape(d: int, dim: int) -> tuple[int, ...]:
    h = max(2 * dim, min(64, 2 * d))
    return d, h, dim, h, d


def first_weights(sizes: tuple[int, ...], seed: int = 0) -> np.ndarray:
    """Uniform weights within one over the root of a layer's inputs."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, (a + 1) * b) / np.sqrt(a) for a, b in zip(sizes, sizes[1:])])


def layers(weights: np.ndarray, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, offsets) of each layer, views of the vector."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def forward(z: np.ndarray, net: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The rows and every layer's output; first and third layer are rectified."""
    out = [z]
    for i, (m, c) in enumerate(net):
        v = out[-1] @ m + c
        out.append(np.maximum(v, 0) if i % 2 == 0 else v)
    return out


def gradient(z: np.ndarray, weights: np.ndarray, sizes: tuple[int, ...]) -> tuple[float, np.ndarray]:
    """Mean squared error over rows and features, and its slope in every weight, by back-propagation."""
    net = layers(weights, sizes)
    out = forward(z, net)
    back = 2 * (out[-1] - z) / z.size
    loss = float(((out[-1] - z) ** 2).mean())
    parts: list[np.ndarray] = []
    for i in range(len(net) - 1, -1, -1):
        if i % 2 == 0:
            back = back * (out[i + 1] > 0)
        parts += [back.sum(axis=0), (out[i].T @ back).ravel()]
        back = back @ net[i][0].T
    return loss, np.concatenate(parts[::-1])


def steps(z: np.ndarray, weights: np.ndarray, sizes: tuple[int, ...], turn: int, rate: float) -> np.ndarray:
    """Weights after ``STEPS`` steps of Adam on batches in a fixed order; the moments begin anew in each round."""
    w = weights.copy()
    first, second = np.zeros_like(w), np.zeros_like(w)
    order = np.random.default_rng(turn).permutation(len(z))
    for t in range(1, STEPS + 1):
        own = order[np.arange((t - 1) * BATCH, t * BATCH) % len(z)] if len(z) > BATCH else order
        _, g = gradient(z[own], w, sizes)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def _numbers(features: tuple[str, ...]) -> Column:
    """Are all of a row's features, as doubles, numbers?"""
    ok = F.col("dataset").isNotNull()
    for f in features:
        ok = ok & F.col(f).isNotNull() & ~F.isnan(f) & (F.abs(F.col(f)) < float("inf"))
    return ok


def _finite(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Rows whose features are all numbers; the others take no part and get no result."""
    x = rows.select("dataset", "row_id", *[F.col(f).cast("double").alias(f) for f in features])
    return x.where(_numbers(features))


def fit(rows: DataFrame, features: tuple[str, ...], dim: int = 8, rounds: int = 8, rate: float = 5e-3, seed: int = 0) -> dict[str, Network]:
    """The network of each data set of ``rows``; min(``dim``, features) latent coordinates.

    A constant feature has deviation 1 and so is always 0. Rounds are fixed, so that results do not hang on a stopping rule. A
    data set's row is in a block by its hash, whatever the partitions; sums of blocks may differ in the last bits.
    """
    spark, d = rows.sparkSession, len(features)
    sizes = shape(d, min(dim, d))
    x = _finite(rows, features)
    spread = [F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f"_{f}") for f in features]
    about = x.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), *spread)
    place = F.pmod(F.xxhash64("row_id", *features), F.ceil(F.col("n") / BLOCK))
    own = F.sort_array(F.collect_list(F.struct("row_id", F.array(*features).alias("x"))))
    blocks = x.join(about.select("dataset", "n"), "dataset").groupBy("dataset", place.alias("block")).agg(own.alias("rows"))
    blocks = stored(blocks.select("dataset", "block", F.flatten("rows.x").alias("x")), "blocks")
    found = about.collect()  # a row for each data set
    begun = first_weights(sizes, seed)
    nets = {r.dataset: Network(sizes, np.array([r[f"_{f}"].m for f in features]), np.array([r[f"_{f}"].s or 1.0 for f in features]), begun) for r in found}
    names = sorted(nets)
    for i in range(0, len(names), SETS):
        some = names[i : i + SETS]
        part = blocks.where(F.col("dataset").isin(some)) if len(names) > SETS else blocks
        for turn in range(rounds):
            sent = spark.sparkContext.broadcast({s: nets[s] for s in some})

            def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
                held: dict[str, tuple[float, np.ndarray]] = {}
                for b in batches:
                    for name, values in zip(b.column("dataset").to_pylist(), b.column("x"), strict=True):
                        net = sent.value[name]
                        z = net.scaled(values.values.to_numpy().reshape(-1, d))
                        n, w = held.get(name, (0.0, 0.0))
                        held[name] = n + len(z), w + len(z) * steps(z, net.weights, sizes, turn, rate)
                for name, (n, w) in held.items():
                    yield pa.RecordBatch.from_pydict({"dataset": [name], "n": [n], "w": [w.tolist()]})

            made = part.mapInArrow(run, "dataset string, n double, w array<double>")
            added = made.select("dataset", "n", F.posexplode("w").alias("i", "w")).groupBy("dataset", "i").agg((F.sum("w") / F.sum("n")).alias("w"))
            whole = added.groupBy("dataset").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]).alias("w"))
            nets |= {r.dataset: replace(nets[r.dataset], weights=np.array(r.w)) for r in whole.collect()}
            sent.unpersist()
    return nets


def _applied(rows: DataFrame, features: tuple[str, ...], nets: dict[str, Network], column: str, kind: DataType, what: Callable[[Network, np.ndarray], np.ndarray]) -> DataFrame:
    """rows with ``column``, what(network, matrix): rows stay where they lie. Data sets without a network are left out."""
    names, spark, out = list(features), rows.sparkSession, None
    kept = [c for c in rows.columns if c != column]
    x = rows.select(*kept).withColumns({f: F.col(f).cast("double") for f in names}).where(_numbers(features) & F.col("row_id").isNotNull())
    sets = sorted(nets)
    for i in range(0, max(len(sets), 1), SETS):
        some = sets[i : i + SETS]
        sent = spark.sparkContext.broadcast({s: nets[s] for s in some})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = np.array(b.column("dataset").to_pylist(), object)
                m = np.stack([b.column(f).to_numpy(zero_copy_only=False) for f in names], axis=1)
                for name in sorted(set(own.tolist())):
                    at = np.flatnonzero(own == name)
                    values = what(sent.value[name], m[at])
                    part = b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values.tolist())], [*part.schema.names, column])

        part = x.where(F.col("dataset").isin(some))
        made = part.mapInArrow(run, StructType([*part.schema.fields, StructField(column, kind)]))
        out = made if out is None else out.unionByName(made)
    return out


def reconstruction(rows: DataFrame, features: tuple[str, ...], nets: dict[str, Network]) -> DataFrame:
    """rows with error: the distance from what the network makes of a row, in deviations. Rows with a feature that is no number
    are left out."""
    return _applied(rows, features, nets, "error", DoubleType(), lambda net, m: net.errors(m))


def encoded(rows: DataFrame, features: tuple[str, ...], nets: dict[str, Network]) -> DataFrame:
    """rows with latent: their coordinates in the narrow layer."""
    return _applied(rows, features, nets, "latent", ArrayType(DoubleType()), lambda net, m: net.encode(m))


def off_manifold(candidates: DataFrame, normals: DataFrame, features: tuple[str, ...], nets: dict[str, Network], low: float = 0.85, high: float = 0.99, least: int = 10) -> DataFrame:
    """Synthetic rows (dataset, k, features) that the network renders badly: the error is above the normals' ``low`` quantile
    and below the candidates' ``high`` one. Data sets where fewer than ``least`` are left give none."""
    n = reconstruction(normals.select("dataset", "row_id", *features), features, nets)
    c = reconstruction(candidates.withColumnRenamed("k", "row_id"), features, nets).withColumnRenamed("row_id", "k")
    low_cut = n.groupBy("dataset").agg(F.percentile("error", low).alias("_lo"))
    high_cut = c.groupBy("dataset").agg(F.percentile("error", high).alias("_hi"))
    kept = c.join(low_cut, "dataset").join(high_cut, "dataset").where("error > _lo AND error < _hi")
    return kept.withColumn("_m", F.count(F.lit(1)).over(W.partitionBy("dataset"))).where(F.col("_m") >= least).select("dataset", "k", *features, "error")


def latent_distances(rows: DataFrame, normals: DataFrame, features: tuple[str, ...], nets: dict[str, Network], rounds: int = 10) -> DataFrame:
    """rows with far: the distance to the nearest part's mean of a mixture of the normals' latent coordinates, in deviations of
    these. A data set of n normals has min(6, max(2, n // 200)) parts."""
    dim = next(iter(nets.values())).sizes[2]
    axes = tuple(f"_l{i}" for i in range(dim))
    flat = stored(encoded(normals.select("dataset", "row_id", *features), features, nets).select("dataset", "row_id", *[F.col("latent")[i].alias(a) for i, a in enumerate(axes)]), "latents")
    about = flat.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"), *[F.struct(F.avg(a).alias("m"), (F.stddev_pop(a) + 1e-6).alias("s")).alias(f"_s{a}") for a in axes])
    scaled = [((F.col(a) - F.col(f"_s{a}.m")) / F.col(f"_s{a}.s")).alias(a) for a in axes]
    parts, _ = fit_mixture(flat.join(about, "dataset").select("dataset", "row_id", *scaled), axes, tuple(range(2, 7)), rounds)
    counts = {r[0]: min(6, max(2, r[1] // 200)) for r in about.select("dataset", "_n").collect()}
    means = [(s, parts[s, k][1].tolist()) for s, k in counts.items() if (s, k) in parts]
    centres = rows.sparkSession.createDataFrame(means, "dataset string, _c array<array<double>>")
    own = F.array(*[(F.col("latent")[i] - F.col(f"_s{a}.m")) / F.col(f"_s{a}.s") for i, a in enumerate(axes)])
    x = encoded(rows, features, nets).join(about, "dataset").join(centres, "dataset").withColumn("_v", own)
    far = "array_min(transform(_c, c -> sqrt(aggregate(zip_with(c, _v, (a, b) -> (a - b) * (a - b)), 0.0D, (s, t) -> s + t))))"
    return x.withColumn("far", F.expr(far)).select(*rows.columns, "far")


def latent_bands(normals: DataFrame, features: tuple[str, ...], nets: dict[str, Network], n: int, seed: object, shares: tuple[float, ...] = (0.25, 0.5, 1.0), bands: tuple[tuple[int, int], ...] = ((50, 70), (70, 90), (90, 100))) -> DataFrame:
    """(dataset, share, band, k, features, far): synthetic rows of a dialled difficulty.

    Candidates are rows that take a ``share`` of their features from other rows, so every value is an observed one; of those
    whose latent distance lies between two percentiles of the candidates', ``n`` are drawn by hash. A cell with fewer gives none.
    """
    cells = []
    for share in shares:
        swapped = max(1, round(share * len(features)))
        c = shuffle_features(normals, features, n * OVERSAMPLE, f"{seed}:{share}", swapped, multi=True)
        cells.append(c.select("dataset", F.lit(float(share)).alias("share"), "k", *features))
    made = cells[0]
    for c in cells[1:]:
        made = made.unionByName(c)
    keyed = stored(made.withColumn("row_id", F.concat_ws(":", "share", "k")), "candidates")
    far = stored(latent_distances(keyed, normals, features, nets).withColumn("far", F.round("far", 9)), "far")
    edges = sorted({e for b in bands for e in b})
    cut = far.groupBy("dataset", "share").agg(F.percentile("far", F.array(*[F.lit(e / 100) for e in edges])).alias("_q"))
    where = F.explode(F.array(*[F.struct(F.lit(f"{lo}-{hi}").alias("band"), F.lit(edges.index(lo)).alias("lo"), F.lit(edges.index(hi)).alias("hi")) for lo, hi in bands]))
    inside = far.join(cut, ["dataset", "share"]).withColumn("_b", where).where(F.expr("far >= _q[_b.lo] AND far <= _q[_b.hi]"))
    inside = inside.withColumn("band", F.col("_b.band"))
    w = W.partitionBy("dataset", "share", "band")  # at most n * OVERSAMPLE rows
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "band", "row_id"))
    drawn = inside.withColumn("_k", F.row_number().over(w.orderBy(order))).withColumn("_m", F.count(F.lit(1)).over(w))
    return drawn.where((F.col("_k") <= n) & (F.col("_m") >= n)).select("dataset", "share", "band", "k", *features, "far")
