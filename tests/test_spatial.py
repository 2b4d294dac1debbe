"""The tree of cells against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftlake.operators import dedup, detectors, space, spatial
from siftlake.operators.spatial import CellTree


def brute(points, rows, features, k):
    out = []
    for p in points.itertuples():
        r = rows[(rows.dataset == p.dataset) & (rows.row_id != p.row_id)]
        d = np.zeros(len(r))
        for f in features:
            d += (getattr(p, f) - r[f].to_numpy()) ** 2
        r = r.assign(d=np.sqrt(d)).dropna(subset=["d"]).sort_values(["d", "row_id"])[:k]
        out += [(p.dataset, p.row_id, int(o), round(float(d), 12), i + 1) for i, (o, d) in enumerate(zip(r.row_id, r.d, strict=True))]
    return sorted(out)


def found(df):
    return sorted((r.dataset, r.row_id, r.other, round(r.distance, 12), r.place) for r in df.collect())


def clouds(rng, n, d):
    x = np.concatenate([rng.normal(size=(n // 2, d)) * 3, rng.normal(size=(n - n // 2, d)) * 0.1 + 5])
    x[rng.random(n) < 0.3] = 1.0  # one vector holds a third of the rows
    x[:5] *= 1e6
    x[:, 1] = np.round(x[:, 1])
    return x


@pytest.mark.parametrize(("d", "k", "cell"), [(2, 1, 8), (3, 7, 16), (5, 20, 32), (2, 5, 4096)])
def test_neighbours_are_those_of_all_pairs(spark, d, k, cell, monkeypatch):
    monkeypatch.setattr(spatial, "FAN", 4)
    monkeypatch.setattr(spatial, "BLOCK", 50)
    monkeypatch.setattr(spatial, "SMALL", 8 if d == 3 else 20_000)
    rng = np.random.default_rng(d)
    features = tuple(f"x{i}" for i in range(d))
    rows = pd.DataFrame(clouds(rng, 600, d), columns=features).assign(row_id=np.arange(600), dataset="a")
    few = pd.DataFrame(rng.normal(size=(3, d)), columns=features).assign(row_id=np.arange(3), dataset="b")
    rows = pd.concat([rows, few])
    rows.loc[17, "x0"] = None
    rows.index = range(len(rows))
    points = pd.concat([rows[rows.row_id % 7 == 0], pd.DataFrame(rng.normal(size=(20, d)) * 4, columns=features).assign(row_id=np.arange(900, 920), dataset="a"), few.assign(dataset="c")])
    kind = "dataset string, row_id long, " + ", ".join(f"{f} double" for f in features)
    frame = lambda x: spark.createDataFrame(x[["dataset", "row_id", *features]].astype(object).where(x.notna(), None).values.tolist(), kind)
    tree = CellTree.build(frame(rows), features, k, cell)
    if cell < 100:
        assert len(tree.levels) > 1
        sizes = tree.points.groupBy("dataset", "node").count().agg(F.max("count")).first()[0]
        assert sizes <= max(cell, k + 1)
    assert tree.points.where("dataset = 'a' AND x = 1".replace("x", "f0")).count() <= 2 * (k + 1) + 300
    assert found(tree.search(frame(points), k)) == brute(points.dropna(), rows, features, k)
    assert found(space.neighbours(frame(points), frame(rows), features, k)) == brute(points.dropna(), rows, features, k)


def test_a_tree_answers_up_to_what_it_was_built_for(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(9)], "dataset string, row_id long, x double")
    tree = CellTree.build(rows, ("x",), 2, 3)
    assert [r.other for r in tree.search(rows.where("row_id = 0"), 1).collect()] == [1]
    with pytest.raises(ValueError):
        tree.search(rows, 3)
    assert CellTree.build(rows.where("false"), ("x",), 2).search(rows, 1).collect() == []
    assert tree.search(rows.where("false"), 1).collect() == []


def test_outlier_factor_over_cells(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CELL", 32)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 2)), 2)
    df = spark.createDataFrame([("a", i, *map(float, v)) for i, v in enumerate(x)], "dataset string, row_id long, x0 double, x1 double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    radius = np.take_along_axis(d, near, 1).max(axis=1)
    lrd = 1 / np.maximum(np.take_along_axis(d, near, 1), radius[near]).mean(axis=1)
    want = lrd[near].mean(axis=1) / lrd
    got = {r.row_id: r.score for r in detectors.lof(df, ("x0", "x1"), 10).collect()}
    assert got == pytest.approx(dict(enumerate(want)))


@pytest.mark.parametrize("d", [1, 2, 3])
def test_cover_is_the_sequential_loop(spark, d):
    rng = np.random.default_rng(d)
    sets = {"a": rng.normal(size=(250, d)), "b": np.repeat(rng.normal(size=(8, d)), 20, axis=0), "c": np.arange(40)[:, None] * np.full((1, d), 0.3)}
    names = tuple(f"x{i}" for i in range(d))
    data = [(s, i * 7 % 1009, *map(float, v)) for s, x in sets.items() for i, v in enumerate(x)]
    rows = spark.createDataFrame(data, "dataset string, row_id long, " + ", ".join(f"{n} double" for n in names))
    radii = spark.createDataFrame([("a", 0.35), ("b", 0.2), ("c", 0.45)], "dataset string, r double")
    want = []
    for s, r in (("a", 0.35), ("b", 0.2), ("c", 0.45)):
        left = sorted((i, np.array(v)) for t, i, *v in data if t == s)
        while left:
            i, v = left[0]
            want.append((s, i))
            left = [(j, u) for j, u in left if np.sqrt(((u - v) ** 2).sum()) > r]
    assert sorted((r.dataset, r.row_id) for r in dedup.cover(rows, names, radii).collect()) == sorted(want)
    assert dedup.cover(rows.where("false"), names, radii).collect() == []
