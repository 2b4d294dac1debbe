"""Gaussian mixtures with diagonal covariances over all rows, for every number of parts at once.

Each round of expectation and maximisation is one pass: a task adds up, for each (data set, k, part), the rows' shares, and
the shares times values and their squares, so that what is shuffled does not grow with the rows; the sums give the next
parameters. Parameters of at most ``SETS`` data sets are broadcast at a time. Fits begin from k-means on a hash draw of
``SAMPLE`` rows of a data set; every round sees all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.operators import space
from siftlake.session import stored

SAMPLE = 2000  #: rows of a data set that the first centres are found on
SETS = 256  #: data sets whose parameters are broadcast at a time
RIDGE = 1e-4  #: added to every variance
DRAWS = 1500

Parts = tuple[np.ndarray, np.ndarray, np.ndarray]  # weights, means, variances


def first_parts(x: np.ndarray, k: int, seed: int = 0, rounds: int = 10) -> Parts:
    """k-means++ and a few rounds of Lloyd's rule."""
    rng = np.random.default_rng((seed, k))
    c = [x[0]]
    for _ in range(k - 1):
        d = ((x[:, None] - np.array(c)[None]) ** 2).sum(axis=2).min(axis=1)
        c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[0])
    centres = np.array(c)
    for _ in range(rounds):
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
    own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    n = np.bincount(own, minlength=k) + 1e-9
    spread = np.array([x[own == j].var(axis=0) if (own == j).any() else x.var(axis=0) for j in range(k)]) + RIDGE
    return n / n.sum(), centres, spread


def log_densities(x: np.ndarray, parts: Parts) -> np.ndarray:
    """ln(weight * density) of each row under each part."""
    w, m, v = parts
    return np.log(w) - 0.5 * (np.log(2 * np.pi * v).sum(axis=1) + ((x[:, None] - m[None]) ** 2 / v[None]).sum(axis=2))


def likelihood(x: np.ndarray, parts: Parts) -> np.ndarray:
    log = log_densities(x, parts)
    top = log.max(axis=1)
    return top + np.log(np.exp(log - top[:, None]).sum(axis=1))


def sums(x: np.ndarray, parts: Parts) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of each part the shares of the rows, shares times values, and times squares; and the log-likelihood."""
    log = log_densities(x, parts)
    top = log.max(axis=1, keepdims=True)
    share = np.exp(log - top)
    total = share.sum(axis=1, keepdims=True)
    share /= total
    return share.sum(axis=0), share.T @ x, share.T @ x**2, float((top + np.log(total)).sum())


def next_parts(n: np.ndarray, first: np.ndarray, second: np.ndarray) -> Parts:
    n = n + 1e-9
    m = first / n[:, None]
    return n / n.sum(), m, np.maximum(second / n[:, None] - m**2, 0) + RIDGE


def _blocks(frame: pa.RecordBatch, names: list[str]):
    """(data set, its rows' features) of a batch, data set by data set."""
    sets = np.array(frame.column("dataset").to_pylist(), object)
    x = np.stack([frame.column(f).to_numpy(zero_copy_only=False) for f in names], axis=1)
    for name in set(sets.tolist()):
        at = np.flatnonzero(sets == name)
        yield name, at, x[at]


def fit(rows: DataFrame, features: tuple[str, ...], ks: tuple[int, ...] = tuple(range(1, 9)), rounds: int = 25, seed: int = 0) -> tuple[dict, DataFrame]:
    """The parts of each (data set, k), and (dataset, k, n, loglik, bic): rows with a null feature take no part.

    The number of parameters is bounded by the number of data sets, never by the rows. Rounds are fixed, so that results do not
    hang on a stopping rule.
    """
    spark, names, d = rows.sparkSession, list(features), len(features)
    x = stored(rows.select("dataset", "row_id", *[F.col(f).cast("double").alias(f) for f in names]).dropna(), "mixture-rows")
    place = F.row_number().over(W.partitionBy("dataset").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row_id").cast("string")))))
    few = x.withColumn("_k", place).where(F.col("_k") <= SAMPLE)

    def begin(df: pd.DataFrame) -> pd.DataFrame:
        own = df.sort_values("_k")[names].to_numpy(float)
        parts = [(k, *first_parts(own, k, seed)) for k in ks if k <= len(own)]
        return pd.DataFrame([{"dataset": df["dataset"].iloc[0], "k": k, "w": w.tolist(), "m": m.ravel().tolist(), "v": v.ravel().tolist()} for k, w, m, v in parts], columns=["dataset", "k", "w", "m", "v"])

    begun = few.groupBy("dataset").applyInPandas(begin, "dataset string, k int, w array<double>, m array<double>, v array<double>")
    begun = stored(begun, "mixture-parts")
    sets = sorted(r[0] for r in begun.select("dataset").distinct().collect())
    done, likely = {}, []
    for i in range(0, len(sets), SETS):
        some = sets[i : i + SETS]
        parts = {(r.dataset, r.k): (np.array(r.w), np.array(r.m).reshape(-1, d), np.array(r.v).reshape(-1, d)) for r in begun.where(F.col("dataset").isin(some)).collect()}
        own = x.where(F.col("dataset").isin(some)) if len(sets) > SETS else x
        for turn in range(rounds + 1):
            sent = spark.sparkContext.broadcast(parts)

            def run(batches, sent=sent):
                held: dict = {}
                for b in batches:
                    for name, _, v in _blocks(b, names):
                        for k in ks:
                            if (name, k) in sent.value:
                                found = sums(v, sent.value[name, k])
                                had = held.get((name, k))
                                held[name, k] = found if had is None else tuple(p + q for p, q in zip(had, found, strict=True))
                for (name, k), (n, first, second, log) in held.items():
                    yield pa.RecordBatch.from_pydict({"dataset": [name] * k, "k": pa.array([k] * k, pa.int32()), "j": pa.array(range(k), pa.int32()), "n": n, "first": first.tolist(), "second": second.tolist(), "log": [log] + [0.0] * (k - 1)})

            made = own.mapInArrow(run, "dataset string, k int, j int, n double, first array<double>, second array<double>, log double")
            added = [F.array(*[F.sum(F.col(c)[i]) for i in range(d)]).alias(c) for c in ("first", "second")]
            made = made.groupBy("dataset", "k", "j").agg(F.sum("n").alias("n"), *added, F.sum("log").alias("log")).toPandas()
            units = [(key, g.sort_values("j")) for key, g in made.groupby(["dataset", "k"])]
            if turn < rounds:
                parts = {key: next_parts(g["n"].to_numpy(), np.stack(g["first"]), np.stack(g["second"])) for key, g in units}
        for (name, k), g in units:
            n, log = round(float(g["n"].sum())), float(g["log"].sum())
            likely.append((name, int(k), n, log, float((2 * k * d + k - 1) * np.log(n) - 2 * log)))
        done |= parts
    return done, spark.createDataFrame(likely, "dataset string, k int, n bigint, loglik double, bic double")


def orders(rows: DataFrame, features: tuple[str, ...], ks: tuple[int, ...] = tuple(range(1, 9)), rounds: int = 25, seed: int = 0) -> DataFrame:
    """(dataset, n_modes, void_mass, ll_gap) over standardised features.

    n_modes is the number of parts of least BIC; ll_gap what a row's log-likelihood gains over one part, on average;
    void_mass the share of ``DRAWS`` points of the one-part model whose density under the best is below the rows' 5 % quantile.
    """
    spark, names = rows.sparkSession, list(features)
    z = stored(space.standardise(rows.select("dataset", "row_id", *features).dropna(), features), "mixture-z")
    parts, likely = fit(z, features, ks, rounds, seed)
    found = likely.toPandas()  # a row for each (data set, k)
    best = {name: int(g.sort_values(["bic", "k"])["k"].iloc[0]) for name, g in found.groupby("dataset")}
    log = {(r.dataset, r.k): r.loglik / r.n for r in found.itertuples()}
    out = []
    sets = sorted(best)
    for i in range(0, len(sets), SETS):
        some = sets[i : i + SETS]
        sent = spark.sparkContext.broadcast({s: parts[s, best[s]] for s in some})

        def run(batches, sent=sent):
            for b in batches:
                for name, at, v in _blocks(b, names):
                    if name in sent.value:
                        yield pa.RecordBatch.from_pydict({"dataset": [name] * len(at), "score": likelihood(v, sent.value[name])})

        scored = z.select("dataset", *names).mapInArrow(run, "dataset string, score double")
        cut = {r[0]: r[1] for r in scored.groupBy("dataset").agg(F.percentile("score", 0.05)).collect()}
        for s in some:
            _, m, v = parts[s, 1]
            drawn = m + np.sqrt(v) * np.random.default_rng(seed).normal(size=(DRAWS, len(names)))
            out.append((s, best[s], float((likelihood(drawn, parts[s, best[s]]) < cut[s]).mean()), log[s, best[s]] - log[s, 1]))
    return spark.createDataFrame(out, "dataset string, n_modes int, void_mass double, ll_gap double")
