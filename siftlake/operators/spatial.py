"""A stored tree of cells for exact nearest neighbours of any points among any number of rows.

Rows are dealt to cells of about ``CELL`` by cutting, level by level, every cell that is too large at up to ``FAN`` - 1
quantiles of its widest feature: each level is one aggregation for the boxes, one for the cuts, and a join that moves the
rows. A node knows its bounding box and its number of rows. Rows with one vector are kept up to the number of neighbours that
may be asked for and one more, so a vector that a third of all rows share is a few rows, and every cell can be cut.

Equal points are one point of a search, for one neighbour more: each leaves itself out. A search has two rounds. A point goes
down to the nearest cell; the k-th distance there, or the farthest corner of a box with more than k rows, bounds the k-th
distance from above. It then goes down again into every node whose box is no farther than that, and only these cells are
probed. Both descents are joins with one row for each node; while there are few cells, their boxes are compared with batches of
points in place of joins, with the same result. A probe is a cogroup of a cell with a block of its points, so pairs are never
rows, and the shuffle is in proportion to rows and points.

Distances and box distances are summed in the same order, so rounding never parts a box from a row in it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.session import stored

CELL = 1024  #: rows of a cell
FAN = 16  #: children of a node
BLOCK = 4096  #: points that probe a cell at a time
SMALL = 20_000  #: cells whose boxes are sent to all tasks; with more, points go down by joins with the levels of nodes

_KEY = ["dataset", "node"]


class CellTree:
    """``points`` (dataset, node, row_id, features as f0, f1, ...) and ``levels`` of (dataset, node, kids), both stored."""

    def __init__(self, points: DataFrame, root: DataFrame, levels: list[tuple[DataFrame, int]], cells: DataFrame, features: tuple[str, ...], most: int) -> None:
        self.points, self.root, self.levels, self.cells, self.features, self.most = points, root, levels, cells, features, most
        self.names = [f"f{i}" for i in range(len(features))]

    @classmethod
    def build(cls, rows: DataFrame, features: tuple[str, ...], most: int, cell: int | None = None) -> CellTree:
        """The tree of (dataset, row_id, features) for up to ``most`` neighbours. Rows with a null feature are no one's neighbour."""
        cell = cell or CELL
        names = [f"f{i}" for i in range(len(features))]
        x = rows.select("dataset", F.col("row_id").cast("bigint").alias("row_id"), *[F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)])
        x = x.dropna(subset=names)
        same = W.partitionBy("dataset", *names).orderBy("row_id")
        x = x.withColumn("_k", F.row_number().over(same)).where(F.col("_k") <= most + 1).drop("_k")
        now = stored(x.withColumn("node", F.lit("r")), "points")
        leaves, cells, levels, root, up = [], [], [], None, None
        while True:
            box = [F.array(*[a(n) for n in names]).alias(b) for a, b in ((F.min, "lo"), (F.max, "hi"))]
            boxes = now.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), *box)
            wide = F.expr("array_max(transform(zip_with(hi, lo, (h, l) -> h - l), (w, i) -> struct(w, i)))")
            boxes = boxes.withColumn("_w", wide).withColumn("leaf", (F.col("n") <= cell) | (F.col("_w.w") <= 0))
            boxes = stored(boxes.select(*_KEY, "n", "lo", "hi", "leaf", F.col("_w.i").alias("at")), "boxes")
            if root is None:
                root = boxes.select(*_KEY, "n", "lo", "hi")
            else:
                kid = F.struct("node", "n", "lo", "hi").alias("kid")
                kids = boxes.select("dataset", F.regexp_extract("node", "^(.*)\\.", 1).alias("up"), kid)
                kids = stored(kids.groupBy("dataset", F.col("up").alias("node")).agg(F.collect_list("kid").alias("kids")), "levels")  # FAN at most
                levels.append((kids, up))
            large = boxes.where("NOT leaf")
            up = large.count()
            leaves.append(now.join(boxes.where("leaf").select(*_KEY), _KEY))
            cells.append(boxes.where("leaf").select(*_KEY, "n", "lo", "hi"))
            if not up:
                break
            value = F.array(*names)[F.col("at")]
            inside = now.join(large.select(*_KEY, "at", F.expr("lo[at]").alias("lo"), F.expr("hi[at]").alias("hi")), _KEY).withColumn("_v", value)
            cuts = inside.groupBy(*_KEY, "at", "lo", "hi").agg(F.percentile_approx("_v", [i / FAN for i in range(1, FAN)], 1000).alias("c"))
            cuts = cuts.withColumn("c", F.expr("array_distinct(filter(c, v -> v < hi))"))
            half = "(CASE WHEN lo / 2 + hi / 2 < hi AND lo / 2 + hi / 2 >= lo THEN lo / 2 + hi / 2 ELSE lo END)"
            cuts = stored(cuts.select(*_KEY, "at", F.expr(f"CASE WHEN size(c) > 0 THEN c ELSE array({half}) END").alias("c")), "cuts")
            child = F.expr(f"size(filter(c, v -> array({','.join(names)})[at] > v))")
            moved = now.join(cuts, _KEY).withColumn("node", F.concat("node", F.lit("."), child.cast("string")))
            now = stored(moved.select(*now.columns), "points")
        return cls(reduce(DataFrame.unionAll, leaves), root, levels, reduce(DataFrame.unionAll, cells), features, most)

    def _low(self, box: str = "c") -> str:
        """SQL: the distance from f0, f1, ... to a box, summed as ``_probe`` sums."""
        away = [f"greatest({box}.lo[{i}] - {n}, {n} - {box}.hi[{i}], 0D)" for i, n in enumerate(self.names)]
        return f"sqrt({' + '.join(['0D', *[f'{a} * {a}' for a in away]])})"

    def _far(self, box: str = "c") -> str:
        """SQL: the distance to the farthest corner, a little enlarged."""
        away = [f"greatest(abs({box}.lo[{i}] - {n}), abs({n} - {box}.hi[{i}]))" for i, n in enumerate(self.names)]
        return f"sqrt({' + '.join(['0D', *[f'{a} * {a}' for a in away]])}) * (1 + 1e-9D)"

    def _sent(self):
        """The boxes of each data set's cells, broadcast, if there are at most ``SMALL``: names, sizes, least and largest values."""
        if self.levels and sum(count for _, count in self.levels) <= SMALL:  # splits; the cells are counted below
            found = self.cells.limit(SMALL + 1).toPandas()
            if len(found) <= SMALL:
                sets = {k: g.sort_values("node") for k, g in found.groupby("dataset")}
                boxes = {k: (g["node"].tolist(), g["n"].to_numpy(), np.stack(g["lo"]), np.stack(g["hi"])) for k, g in sets.items()}
                return self.points.sparkSession.sparkContext.broadcast(boxes)
        return None

    def _compared(self, points: DataFrame, sent, k: int | None) -> DataFrame:
        """points (dataset, row_id, f0, ...) with node and r, as ``_home`` gives them, or, with r and home and no ``k``, as ``_within``."""
        names = self.names
        kinds = "dataset string, row_id bigint, " + ", ".join(f"{n} double" for n in names) + ", node string, r double" + ("" if k is not None else ", home string")

        def run(batches):
            for b in batches:
                own = np.array(b.column("dataset").to_pylist(), object)
                x = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
                for name in set(own.tolist()) & set(sent.value):
                    nodes, n, lo, hi = sent.value[name]
                    mine = np.flatnonzero(own == name)
                    size = max(1, 1_000_000 // len(nodes))
                    for at in (mine[i : i + size] for i in range(0, len(mine), size)):
                        low, far = np.zeros((len(at), len(nodes))), np.zeros((len(at), len(nodes)))
                        for f in range(len(names)):
                            below, above = lo[None, :, f] - x[at, f][:, None], x[at, f][:, None] - hi[None, :, f]
                            low += np.maximum(np.maximum(below, above), 0) ** 2
                            if k is not None:
                                far += np.maximum(np.abs(below), np.abs(above)) ** 2
                        low = np.sqrt(low)
                        if k is not None:
                            i, j = np.arange(len(at)), low.argmin(axis=1)
                            far = np.sqrt(far) * (1 + 1e-9)
                            r = far[:, n > k].min(axis=1, initial=np.inf)
                            if n.sum() > k:
                                r = np.minimum(r, far.max(axis=1))
                            extra = {"node": pa.array([nodes[c] for c in j], pa.string()), "r": r}
                        else:
                            r, home = b.column("r").to_numpy()[at], np.array(b.column("home").to_pylist(), object)[at]
                            i, j = np.nonzero(low <= r[:, None])
                            other = np.array(nodes, object)[j] != home[i]
                            i, j = i[other], j[other]
                            extra = {"node": pa.array([nodes[c] for c in j], pa.string()), "r": r[i], "home": pa.array(home[i].tolist(), pa.string())}
                        rows = b.take(pa.array(at[i]))
                        yield pa.RecordBatch.from_pydict({c: rows.column(c) for c in ("dataset", "row_id", *names)} | extra)

        return points.mapInArrow(run, kinds)

    def _level(self, i: int) -> DataFrame:
        kids, count = self.levels[i]
        return F.broadcast(kids) if count <= SMALL else kids

    def _home(self, points: DataFrame, k: int) -> DataFrame:
        """points with node, the nearest cell by boxes, and r, no less than the k-th distance."""
        beyond = f"CASE WHEN c.n > {k} THEN {self._far()} ELSE double('infinity') END"
        at = points.join(self.root.select("dataset", "node", F.struct("n", "lo", "hi").alias("c")), "dataset").withColumn("r", F.expr(beyond)).drop("c")
        for i in range(len(self.levels)):
            best = F.expr(f"array_min(transform(kids, c -> struct({self._low()} AS low, c.node AS node)))")
            least = F.expr(f"array_min(transform(kids, c -> {beyond}))")
            at = at.join(self._level(i), _KEY, "left").withColumn("_b", best).withColumn("r", F.least("r", least))
            at = at.withColumn("node", F.coalesce("_b.node", "node")).drop("_b", "kids")
        return at

    def _within(self, points: DataFrame) -> DataFrame:
        """points once for each cell that is no farther than r, but for the cell ``home``."""
        at = points.join(self.root.select(*_KEY), "dataset")
        for i in range(len(self.levels)):
            near = F.expr(f"transform(filter(kids, c -> {self._low()} <= r), c -> c.node)")
            at = at.join(self._level(i), _KEY, "left").withColumn("node", F.explode(F.coalesce(near, F.array("node")))).drop("kids")
        return at.where("node <> home")

    def _probe(self, points: DataFrame, k: int) -> DataFrame:
        """(dataset, row_id, other, distance): of each point's cell, the ``k`` nearest rows that are no farther than r."""
        names = self.names
        points = points.select(*_KEY, "row_id", "r", *names)
        blocks = points.groupBy(*_KEY).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n"))
        q = points.join(blocks, _KEY).withColumn("_q", F.pmod(F.xxhash64("row_id"), "_n").cast("int")).drop("_n")
        r = self.points.join(blocks, _KEY).withColumn("_q", F.explode(F.expr("sequence(0, _n - 1)"))).drop("_n")
        r = r.withColumnsRenamed({c: f"{c}_" for c in ("dataset", "node", "_q", "row_id")})

        def nearest(own: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(cell):
                return pd.DataFrame({"dataset": [], "row_id": [], "other": [], "distance": []})
            cell = cell.sort_values("row_id_")
            ids, x, y = cell["row_id_"].to_numpy(), own[names].to_numpy(), cell[names].to_numpy()
            mine, most = own["row_id"].to_numpy(), own["r"].to_numpy()
            row, other, distance = [], [], []
            for a in range(0, len(x), 256):
                part, named = x[a : a + 256], mine[a : a + 256]
                d = np.zeros((len(part), len(y)))
                for f in range(len(names)):
                    d += (part[:, f][:, None] - y[:, f][None]) ** 2
                d = np.sqrt(d)
                d[d > most[a : a + 256][:, None]] = np.inf
                cut = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(part), np.inf)
                i, j = np.nonzero((d <= cut[:, None]) & (d < np.inf))
                order = np.lexsort((j, d[i, j], i))  # ids ascend, so ties do too
                i, j = i[order], j[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
                i, j = i[keep], j[keep]
                row.append(named[i])
                other.append(ids[j])
                distance.append(d[i, j])
            return pd.DataFrame({"dataset": own["dataset"].iloc[0], "row_id": np.concatenate(row), "other": np.concatenate(other), "distance": np.concatenate(distance)})

        met = q.groupBy(*_KEY, "_q").cogroup(r.groupBy("dataset_", "node_", "_q_"))
        return met.applyInPandas(nearest, "dataset string, row_id long, other long, distance double")

    def search(self, points: DataFrame, k: int) -> DataFrame:
        """(dataset, row_id, other, distance, place): the ``k`` nearest rows of each of (dataset, row_id, features), the row of the
        same id excluded; equal distances go by the smaller id. Points with a null feature, or of a data set that the tree
        does not know, have none."""
        if k > self.most:
            raise ValueError(f"the tree was built for up to {self.most} neighbours")
        names = self.names
        x = points.select("dataset", F.col("row_id").cast("bigint").alias("row_id"), *[F.col(f).cast("double").alias(n) for f, n in zip(self.features, names, strict=True)])
        x = x.dropna(subset=names)
        # equal points have the same rows near, but for themselves: a vector is asked once, for one row more
        asked = stored(x.select("dataset", *names).distinct().withColumn("row_id", F.monotonically_increasing_id()), "asked")
        near = F.slice(F.array_sort(F.collect_list(F.struct("distance", "other"))), 1, k + 1)
        found = self._nearest(asked, k + 1).groupBy("dataset", "row_id").agg(near.alias("_l"))
        listed = asked.join(found, ["dataset", "row_id"]).select("dataset", *names, "_l")
        kept = F.expr(f"slice(filter(_l, e -> e.other <> row_id), 1, {k})")
        # the planner sizes lists too low to broadcast them
        own = x.hint("merge").join(listed.hint("merge"), ["dataset", *names]).select("dataset", "row_id", F.posexplode(kept).alias("_p", "e"))
        return own.select("dataset", "row_id", "e.other", "e.distance", (F.col("_p") + 1).alias("place"))

    def _nearest(self, x: DataFrame, k: int) -> DataFrame:
        """(dataset, row_id, other, distance) for (dataset, row_id, f0, ...): the ``k`` nearest rows, and others no nearer."""
        sent = self._sent()
        if not self.levels:
            return self._probe(self._home(x, k), k)
        home = stored(self._compared(x, sent, k) if sent else self._home(x, k), "homes")
        first = stored(self._probe(home, k), "first")
        kth = first.groupBy("dataset", "row_id").agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_d"))
        tight = F.least("r", F.when(F.col("_n") >= k, F.col("_d")))
        rest = home.join(kth, ["dataset", "row_id"], "left").withColumn("r", tight).withColumnRenamed("node", "home").drop("_n", "_d")
        others = self._compared(rest.select("dataset", "row_id", *self.names, "r", "home"), sent, None) if sent else self._within(rest)
        return first.unionAll(self._probe(others, k))
