"""The kernel machine and the mixtures against optimality conditions and a plain numpy fit."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftlake.operators import detectors, mixtures, modality, separability, space


@pytest.mark.parametrize("seed", range(6))
def test_machine_closes_the_duality_gap(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(151, 3))
    if seed % 2:
        x[0] += 4
    y = np.where(np.arange(151) == 0, 1.0, -1.0) if seed < 4 else np.sign(x[:, 0] + 0.3 * rng.normal(size=151))
    cost = 100.0 if seed < 4 else 1.0
    alpha, bias, kernel = separability.machine(x, y, cost)
    assert abs(alpha @ y) < 1e-9 and alpha.min() >= 0 and alpha.max() <= cost
    value = gap = separability.gap(alpha, bias, kernel, y, cost)
    assert -1e-9 <= gap <= 0.02 * max(1.0, alpha.sum())
    margin = y * (kernel @ (alpha * y) + bias)
    assert (margin[alpha < 1e-9] > 1 - 1e-2).all()
    assert margin[(alpha > 1e-6) & (alpha < cost - 1e-6)] == pytest.approx(1, abs=1e-2)
    worse = alpha * 0.9
    assert separability.gap(worse, bias, kernel, y, cost) > value


def test_two_rows_have_a_closed_form():
    x = np.array([[0.0, 0.0], [1.0, 2.0]])
    alpha, bias, kernel = separability.machine(x, np.array([1.0, -1.0]))
    assert alpha == pytest.approx(1 / (1 - kernel[0, 1]))
    assert bias == pytest.approx(0, abs=1e-9)


def test_separability_prefers_the_detector_that_flags_what_stands_apart(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(296, 2)), [[9.0, 9], [-9, 9], [9, -9], [-9, -9]]])
    rows = spark.createDataFrame([("a", i, *map(float, v)) for i, v in enumerate(x)], "dataset string, row_id long, x0 double, x1 double")
    far = F.sqrt(F.col("x0") ** 2 + F.col("x1") ** 2)
    scores = rows.select("dataset", F.lit("far").alias("detector"), "row_id", far.alias("score")).unionAll(rows.select("dataset", F.lit("near"), "row_id", -far))
    got = {r.detector: r for r in separability.separability(scores, rows, ("x0", "x1")).collect()}
    assert got["far"].criterion > got["near"].criterion + 0.1
    assert got["far"].separability - got["far"].chance == pytest.approx(got["far"].criterion)
    flagged = rows.where("row_id >= 296").select("dataset", F.lit("far").alias("detector"), "row_id")
    d = separability._draws(rows, flagged, ["dataset", "detector"], 0).toPandas()
    assert d.groupby("point").size().tolist() == [151] * 4
    assert not d[(d["y"] < 0)]["row_id"].isin(range(296, 300)).any()


def test_mixtures_equal_a_plain_fit(spark):
    rng = np.random.default_rng(7)
    sets = {"two": np.concatenate([rng.normal(-3, 1, (300, 2)), rng.normal(3, 0.5, (200, 2))]), "one": rng.normal(size=(400, 2))}
    rows = spark.createDataFrame([(s, i, *map(float, v)) for s, x in sets.items() for i, v in enumerate(x)], "dataset string, row_id long, x0 double, x1 double").repartition(5)
    parts, likely = mixtures.fit(rows, ("x0", "x1"), (1, 2, 3), rounds=12)
    bic = {(r.dataset, r.k): r for r in likely.collect()}
    for s, x in sets.items():
        order = np.argsort([__import__("hashlib").md5(f"0:{i}".encode()).hexdigest() for i in range(len(x))])
        for k in (1, 2, 3):
            p = mixtures.first_parts(x[order][: mixtures.SAMPLE], k)
            for _ in range(12):
                p = mixtures.next_parts(*mixtures.sums(x, p)[:3])
            for got, want in zip(parts[s, k], p, strict=True):
                assert got == pytest.approx(want)
            log = mixtures.likelihood(x, p).sum()
            assert bic[s, k].loglik == pytest.approx(log)
            assert bic[s, k].bic == pytest.approx((4 * k + k - 1) * np.log(len(x)) - 2 * log)
    got = {r.dataset: r for r in mixtures.orders(rows, ("x0", "x1"), (1, 2, 3), 12).collect()}
    assert (got["one"].n_modes, got["two"].n_modes) == (1, 2)
    assert got["two"].void_mass > got["one"].void_mass == pytest.approx(0.05, abs=0.03)
    assert got["two"].ll_gap > 0.3 and got["one"].ll_gap == 0


def test_densities_of_a_mixture_integrate_to_one():
    p = np.array([0.3, 0.7]), np.array([[-1.0], [2.0]]), np.array([[0.5], [1.5]])
    x = np.linspace(-12, 14, 20001)[:, None]
    assert np.trapezoid(np.exp(mixtures.likelihood(x, p)), x[:, 0]) == pytest.approx(1)
    assert pd.notna(mixtures.likelihood(np.array([[1e6]]), p)).all()


def slow_dip(x, counts):
    """Every value as the mode, hulls by all chords."""
    f = np.cumsum(counts) / counts.sum()
    before = np.concatenate([[0.0], f[:-1]])
    best = 1.0
    chord = lambda i, j, y, k: y[i] + (y[j] - y[i]) * (x[k] - x[i]) / (x[j] - x[i])
    for m in range(len(x)):
        low = high = 0.0
        for k in range(m):
            convex = min([before[k], *(chord(i, j, before, k) for i in range(k) for j in range(k + 1, m + 1))])
            low = max(low, f[k] - convex)
        for k in range(m + 1, len(x)):
            concave = max([f[k], *(chord(i, j, f, k) for i in range(m, k) for j in range(k + 1, len(x)))])
            high = max(high, concave - before[k])
        best = min(best, max(low, high))
    return best / 2


def test_dip_is_exact():
    rng = np.random.default_rng(0)
    for n in (2, 3, 4, 7, 12, 18):
        for _ in range(8):
            x, c = np.sort(rng.normal(size=n)), rng.integers(1, 6, n)
            assert modality.dip(x, c) == pytest.approx(slow_dip(x, c))
    assert modality.dip(np.array([0.0, 1.0]), np.array([5, 5])) == pytest.approx(0.25)
    assert modality.dip(np.array([3.0]), np.array([9])) == 0
    assert modality.dip(np.arange(100.0), np.ones(100)) == pytest.approx(0.005)


def test_dips_of_all_rows_are_within_their_bound(spark):
    rng = np.random.default_rng(1)
    two = np.concatenate([rng.normal(-3, 1, (400, 2)), rng.normal(3, 1, (400, 2))])
    one = rng.normal(size=(700, 2))
    rows = spark.createDataFrame([(s, i, *map(float, v)) for s, x in (("two", two), ("one", one)) for i, v in enumerate(x)], "dataset string, row_id long, x0 double, x1 double").repartition(3)
    v = modality.directions(2, 5)
    for r in modality.dips(rows, ("x0", "x1"), 5).collect():
        x = {"two": two, "one": one}[r.dataset]
        own = ((x - x.mean(axis=0)) / x.std(axis=0)) @ v[:, r.direction]
        assert r.n == len(x)
        assert abs(r.dip - modality.dip(*np.unique(own, return_counts=True))) <= r.bound + 1e-9
    got = {r.dataset: r for r in modality.modality(rows, ("x0", "x1"), 12).collect()}
    assert got["two"].dip_share == 1 and got["one"].dip_share == 0
    assert got["two"].projected_share > 0.5 > got["one"].projected_share
    assert got["two"].least_p == 0 < got["one"].least_p


def test_kernel_axes_equal_those_of_the_whole_matrix(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    rows = spark.createDataFrame([("a", i, *map(float, v)) for i, v in enumerate(x)], "dataset string, row_id long, x0 double, x1 double, x2 double")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    k = np.exp(-((z[:, None] - z[None]) ** 2).sum(axis=2) / 3)
    h = np.eye(120) - 1 / 120
    w, v = np.linalg.eigh(h @ k @ h)
    want = v[:, ::-1][:, :3] * np.sqrt(w[::-1][:3])
    got = np.array([r.z for r in space.kernel_projection(rows, ("x0", "x1", "x2")).orderBy("row_id").collect()])
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-8)


def test_forests_by_key(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 3)), rng.normal(size=(6, 3)) + 6])
    rows = spark.createDataFrame([("a", i, *map(float, v)) for i, v in enumerate(x)], "dataset string, row_id long, x0 double, x1 double, x2 double")
    names = ("x0", "x1", "x2")
    s = detectors.forest_bank(rows, names, {"few": (20, 0.5), "many": (60, 1.0)}, (0, 1, 2), train=rows.where("row_id < 300")).toPandas()
    assert s.groupby(["configuration", "seed"]).size().tolist() == [306] * 6
    for _, own in s.groupby(["configuration", "seed"]):
        top = own.sort_values("score").tail(6)["row_id"]
        assert (top >= 300).sum() >= 4
    wide = s.pivot(index="row_id", columns=["configuration", "seed"], values="score")
    agree = wide.corr("spearman")
    assert agree.loc["many", "many"].to_numpy()[np.triu_indices(3, 1)].mean() > agree.loc["few", "few"].to_numpy()[np.triu_indices(3, 1)].mean()
    grown = detectors._forest(x, 5, 64, np.random.default_rng(0), 0.4)
    assert all(len(set(t[0][t[0] >= 0])) == 1 for t in grown)
