"""Autoencoders: slopes against differences, fits against the plain mean, and what is built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.operators import networks as N

FEATURES = ("a", "b", "c")


def plane(n, seed, dataset):
    """Rows near a curved sheet in three features."""
    rng = np.random.default_rng(seed)
    u, v = rng.normal(size=(2, n))
    x = np.stack([u, v, u * v / 2 + u], axis=1) * [1, 3, 2] + [5, 0, -2] + rng.normal(scale=0.02, size=(n, 3))
    return [(dataset, i, *map(float, r)) for i, r in enumerate(x)]


@pytest.fixture(scope="module")
def rows(spark):
    found = plane(2600, 1, "p") + plane(700, 2, "q")
    return spark.createDataFrame(found, "dataset string, row_id long, a double, b double, c double")


@pytest.fixture(scope="module")
def nets(rows):
    return N.fit(rows, FEATURES, dim=2)


def test_slopes_are_those_of_differences():
    sizes = N.shape(3, 2)
    w, z = N.first_weights(sizes, 3), np.random.default_rng(4).normal(size=(7, 3))
    _, g = N.gradient(z, w, sizes)
    for i in range(0, len(w), 5):
        e = np.zeros_like(w)
        e[i] = 1e-6
        slope = (N.gradient(z, w + e, sizes)[0] - N.gradient(z, w - e, sizes)[0]) / 2e-6
        assert abs(slope - g[i]) < 1e-6


def test_a_fit_renders_rows_better_than_their_mean_and_strange_rows_worse(rows, nets, spark):
    error = {r[0]: r[1] for r in N.reconstruction(rows, FEATURES, nets).groupBy("dataset").agg(F.avg("error")).collect()}
    assert set(error) == {"p", "q"}
    assert all(e < 0.6 for e in error.values())  # the mean alone leaves about 1.6
    odd = spark.createDataFrame([("p", -1, 5.0, 0.0, 9.0), ("p", -2, 5.0, 0.0, -14.0)], rows.schema)
    assert all(r.error > 5 * error["p"] for r in N.reconstruction(odd, FEATURES, nets).collect())


def test_a_fit_does_not_hang_on_partitions(rows, nets):
    again = N.fit(rows.repartition(7, "a"), FEATURES, dim=2)
    for s in nets:
        assert np.allclose(nets[s].weights, again[s].weights, atol=1e-6)


def test_results_are_those_of_the_network_row_by_row(rows, nets):
    got = N.encoded(rows.where("row_id < 20"), FEATURES, nets).collect()
    assert len(got) == 40
    for r in got:
        assert np.allclose(r.latent, nets[r.dataset].encode(np.array([[r.a, r.b, r.c]]))[0])


def test_rows_that_are_no_numbers_take_no_part(spark, rows, nets):
    odd = [("p", 9001, None, 1.0, 1.0), ("p", 9002, float("nan"), 1.0, 1.0), ("q", 9003, float("inf"), 1.0, 1.0), (None, 9004, 1.0, 1.0, 1.0)]
    more = rows.unionByName(spark.createDataFrame(odd, rows.schema))
    again = N.fit(more, FEATURES, dim=2, rounds=1)
    assert set(again) == {"p", "q"}
    assert N.reconstruction(more, FEATURES, nets).count() == rows.count()
    assert N.fit(rows.limit(0), FEATURES) == {}
    assert N.reconstruction(rows.limit(0), FEATURES, nets).count() == 0


def test_a_constant_feature_and_a_single_row(spark):
    flat = spark.createDataFrame([("s", 1, 1.0, 2.0, 3.0)] + [("t", i, float(i), 4.0, 4.0) for i in range(40)], "dataset string, row_id long, a double, b double, c double")
    nets = N.fit(flat, FEATURES, rounds=2)
    assert all(np.isfinite(r.error) for r in N.reconstruction(flat, FEATURES, nets).collect())


def test_off_manifold_rows_lie_between_two_errors(rows, nets):
    from siftlake.operators.synth import shuffle_features

    c = shuffle_features(rows, FEATURES, 400, 5, 1, multi=True)
    kept = N.off_manifold(c, rows, FEATURES, nets).collect()
    normal = {s: np.array([r.error for r in N.reconstruction(rows.where(F.col("dataset") == s), FEATURES, nets).collect()]) for s in "pq"}
    every = N.reconstruction(c.withColumnRenamed("k", "row_id"), FEATURES, nets).collect()
    for s in "pq":
        own = np.array([r.error for r in every if r.dataset == s])
        low, high = np.quantile(normal[s], 0.85), np.quantile(own, 0.99)
        assert sum(r.dataset == s for r in kept) == int(((own > low) & (own < high)).sum()) >= 10


def test_bands_hold_observed_values_and_grow(rows, nets):
    made = N.latent_bands(rows, FEATURES, nets, 30, 7).collect()
    assert len(made) == 2 * 3 * 3 * 30
    seen = {(r.dataset, f, r[f]) for r in rows.collect() for f in FEATURES}
    assert all((r.dataset, f, r[f]) in seen for r in made for f in FEATURES)
    for s in "pq":
        for share in (0.25, 0.5, 1.0):
            far = [[r.far for r in made if (r.dataset, r.share, r.band) == (s, share, b)] for b in ("50-70", "70-90", "90-100")]
            assert max(far[0]) <= min(far[1]) and max(far[1]) <= min(far[2])


def test_synthetic_rows_are_graded_against_held_out_normals(spark, rows, nets):
    from siftlake.operators import pseudo as G

    far = spark.createDataFrame([(s, arm, k, x + k / 100, 0.0, 0.0) for s in "pq" for arm, x in (("far", 60.0), ("near", 5.0)) for k in range(30)], "dataset string, arm string, k long, a double, b double, c double")
    got = G.synthetic_quality(rows, far, FEATURES, ["MaxZ"], ["arm"], 3).collect()
    assert len(got) == 4
    size = {"p": 2600, "q": 700}
    for r in got:
        assert r.n_pos == 30 and r.n_train + r.n_neg == size[r.dataset] and 0.25 < r.n_neg / size[r.dataset] < 0.35
        assert r.auc == 1.0 if r.arm == "far" else r.auc < 0.7
