"""Hard negatives of anchors: rows of another label that score within a window below each of the anchor's positives.

Anchors lie in blocks of about ``BLOCK``. The anchors of a block form a minimum spanning tree of their distances. A row's
score at a parent anchor bounds its score at the child: the inner products differ by at most the edge's length times the
row's norm (Cauchy-Schwarz). A row whose bound misses an anchor's window keeps the widened bound for the anchors below it; only
rows whose bound overlaps the window are scored again, exactly. Windows narrow while a task reads: a row below the worst of
the rows found so far overlaps no more.

All rows are scanned where they lie, ``PASS`` blocks of anchors at a time: the trees of a pass are broadcast (at most
``PASS * BLOCK`` anchors, whatever the corpus), and each task returns its best rows of each anchor, so vectors are never
shuffled and pairs are never rows. Scores are integers, and bounds carry a margin over the rounding of doubles, so results are
exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.llm import store, text

BLOCK = 1024  #: anchors of a spanning tree, on average
PASS = 16  #: trees that a scan of the rows takes along
CHUNK = 2048  #: rows that a tree is walked with at a time


@dataclass
class Tree:
    """Anchors in an order that has each parent before its children; ``parent`` of the first is -1."""

    block: int
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parent: np.ndarray
    edge: np.ndarray


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree by Prim's rule; ``parent`` holds places in ``order``."""
    m = len(vectors)
    order, parent, edge = np.zeros(m, np.int64), np.full(m, -1), np.zeros(m)
    near, by, left = np.full(m, np.inf), np.full(m, -1), np.ones(m, bool)
    for k in range(m):
        i = int(np.argmin(np.where(left, near, np.inf))) if k else 0
        order[k], left[i] = i, False
        if k:
            parent[k], edge[k] = by[i], near[i]
        d = np.sqrt(((vectors - vectors[i]) ** 2).sum(axis=1))
        closer = left & (d < near)
        near[closer], by[closer] = d[closer], k
    return order, parent, edge


def exact(rows: np.ndarray, anchor: np.ndarray, largest: float) -> np.ndarray:
    """Integer inner products: by doubles while every partial sum fits one, else by Python's integers."""
    if largest < 1 << 53:
        return (rows @ anchor).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(r, anchor, strict=True)) for r in rows], dtype=object).astype(np.int64)


def walk(tree: Tree, rows: np.ndarray, wanted):
    """Yield (anchor, places, scores): the rows whose bounds ``wanted(anchor, low, high)`` marks, scored exactly."""
    with np.errstate(over="ignore"):
        norms = np.sqrt((rows**2).sum(axis=1))
    top = float(norms.max(initial=0))
    low, high = np.full((len(tree.ids), len(rows)), -np.inf), np.full((len(tree.ids), len(rows)), np.inf)
    for k, anchor in enumerate(tree.vectors):
        size = float(np.sqrt((anchor**2).sum()))
        if tree.parent[k] < 0:
            low[k], high[k] = -size * norms, size * norms
        else:
            low[k], high[k] = low[tree.parent[k]] - tree.edge[k] * norms, high[tree.parent[k]] + tree.edge[k] * norms
        slack = 1 + 1e-9 * size * top
        at = np.flatnonzero(wanted(k, low[k] - slack, high[k] + slack))
        if len(at):
            scores = exact(rows[at], anchor, size * top)
            low[k, at] = high[k, at] = scores
            yield k, at, scores


def rows_of(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", flip: int = 0, labels: int = 10) -> DataFrame:
    """(id, label, x): rows with an id, a label and a vector of finite components. Where ``flip`` divides the id, the label is the next of ``labels``."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.col(label_col).cast("bigint")
    if flip:
        label = F.when(F.col(id_col) % flip == 0, (label + 1) % labels).otherwise(label)
    return table.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("bigint").alias("id"), label.alias("label"), x.alias("x"))


def _matrix(column: pa.ListArray, scale: float, wide: int) -> np.ndarray:
    """floor(scale * x) as doubles; a shorter vector ends in zeros."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    size = np.diff(ends)
    out = np.zeros((len(size), wide))
    out[np.arange(wide)[None, :] < size[:, None]] = np.floor(scale * flat)
    return out


def _trees(anchors: DataFrame, scale: float, wide: int) -> DataFrame:
    """One stored row for each block: its tree."""
    count = anchors.count()
    blocks = -(-count // BLOCK)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "label"]).reset_index(drop=True)
        v = np.zeros((len(pdf), wide))
        for i, x in enumerate(pdf["x"]):
            v[i, : len(x)] = np.floor(scale * np.asarray(x, float))
        order, parent, edge = spanning_tree(v)
        one = {"block": pdf["block"].iloc[0], "ids": pdf["id"].to_numpy()[order].tolist(), "labels": pdf["label"].to_numpy()[order].tolist()}
        return pd.DataFrame([one | {"vectors": v[order].tobytes(), "parent": parent.tolist(), "edge": edge.tolist()}])

    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("id", "label", "x"), F.lit(max(1, blocks))).cast("int"))
    made = dealt.groupBy("block").applyInPandas(build, "block int, ids array<bigint>, labels array<bigint>, vectors binary, parent array<int>, edge array<double>")
    return store.stash(made, "anchor-trees")


def _passes(trees: DataFrame, wide: int):
    """Lists of trees, ``PASS`` blocks each."""
    blocks = sorted(r.block for r in trees.select("block").collect())
    for i in range(0, len(blocks), PASS):
        found = trees.where(F.col("block").isin(blocks[i : i + PASS])).collect()
        yield [Tree(r.block, np.array(r.ids, np.int64), np.array(r.labels, np.int64), np.frombuffer(bytes(r.vectors)).reshape(-1, wide), np.array(r.parent), np.array(r.edge)) for r in found]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((ids, -scores))[:k]
    return scores[keep], ids[keep]


def _scan(rows: DataFrame, trees: list[Tree], windows: list[list], want: int, same: bool, scale: float, wide: int) -> DataFrame:
    """(block, anchor, slot, id, score): of each task's rows, the best ``want`` of each slot of each anchor.

    ``windows[tree][anchor]`` lists (low, high) for each slot. ``same``: rows of the anchor's label other than it, else rows of others.
    """
    sent = rows.sparkSession.sparkContext.broadcast((trees, windows))

    def run(batches):
        trees, windows = sent.value
        best = [[[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in slots] for slots in w] for w in windows]
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                part = b.slice(i, CHUNK)
                ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
                x = _matrix(part.column("x"), scale, wide)
                for tree, slots, found in zip(trees, windows, best, strict=True):

                    def floor_of(k: int, s: int) -> int:
                        low, _ = slots[k][s]  # noqa: B023
                        kept = found[k][s][0]  # noqa: B023
                        return max(low, int(kept[-1])) if len(kept) == want else low

                    def wanted(k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                        alike = labels == tree.labels[k]  # noqa: B023
                        fits = np.zeros(len(low), bool)
                        for s, (_, top) in enumerate(slots[k]):  # noqa: B023
                            fits |= ~(high < floor_of(k, s)) & ~(low > top)  # noqa: B023  what is no number overlaps
                        return fits & (alike & (ids != tree.ids[k]) if same else ~alike)  # noqa: B023

                    for k, at, scores in walk(tree, x, wanted):
                        for s, (_, top) in enumerate(slots[k]):
                            fits = (scores >= floor_of(k, s)) & (scores <= top)
                            if fits.any():
                                had = found[k][s]
                                found[k][s] = _best(np.concatenate([had[0], scores[fits]]), np.concatenate([had[1], ids[at[fits]]]), want)
        for tree, found in zip(trees, best, strict=True):
            at = [(k, s, len(f[0])) for k, slots in enumerate(found) for s, f in enumerate(slots) if len(f[0])]
            if at:
                n = [c for _, _, c in at]
                kept = [found[k][s] for k, s, _ in at]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array(np.full(sum(n), tree.block), pa.int32()),
                        "anchor": pa.array(np.repeat([k for k, _, _ in at], n), pa.int32()),
                        "slot": pa.array(np.repeat([s for _, s, _ in at], n), pa.int32()),
                        "id": np.concatenate([f[1] for f in kept]),
                        "score": np.concatenate([f[0] for f in kept]),
                    }
                )
        text.tidy()

    found = text.bounded(rows).mapInArrow(run, "block int, anchor int, slot int, id bigint, score bigint")
    order = W.partitionBy("block", "anchor", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want)


def mine(rows: DataFrame, anchors: DataFrame, scale: float = 256.0, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows and anchors as ``rows_of`` gives them.

    A score is the inner product of the vectors' floor(scale * x). An anchor's positives are its best ``positives`` other rows of
    its label; for each, the first ``negatives`` rows of other labels whose score is between ``window`` per cent of the
    positive's. Higher scores come first, ties by smaller id. Rows with another id than the anchor's are other rows; repeated
    rows are ranked as rows, repeated anchors are one; a shorter vector counts as ending in zeros; a label without a second row
    has no positives; empty tables give an empty result. Scores beyond 64 bits raise.
    """
    spark = rows.sparkSession
    anchors = anchors.distinct()
    wide = max(1, rows.agg(F.max(F.size("x"))).first()[0] or 0, anchors.agg(F.max(F.size("x"))).first()[0] or 0)
    trees = _trees(anchors, scale, wide)
    out = []
    for some in _passes(trees, wide):
        open_ended = [[[(-(1 << 63), (1 << 63) - 1)] for _ in t.ids] for t in some]
        best = store.stash(_scan(rows, some, open_ended, positives, True, scale, wide), "positives")
        mine_ = {t.block: [[] for _ in t.ids] for t in some}
        for r in best.orderBy("block", "anchor", "rank").collect():  # at most PASS * BLOCK * positives
            mine_[r.block][r.anchor].append((-(-window[0] * r.score // 100), window[1] * r.score // 100))
        found = _scan(rows, some, [mine_[t.block] for t in some], negatives, False, scale, wide)
        names = spark.createDataFrame([(t.block, k, int(i)) for t in some for k, i in enumerate(t.ids)], "block int, anchor int, anchor_id bigint")
        of = best.select("block", "anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = found.join(of, ["block", "anchor", "slot"]).join(names, ["block", "anchor"])
        out.append(store.stash(found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    if not out:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionAll(more)
    return whole
