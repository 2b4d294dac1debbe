"""Pseudo-label evaluation: hold out clusters as if they were anomalies, and grade detectors on them.

Rows are (dataset, row_id, cluster, z, ...); subsets are long membership tables (dataset, subset, row_id, role).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions.ranks import average_rank, draw_order
from siftlake.operators import metrics as M
from siftlake.session import stored


def candidates(clusters: DataFrame, selection: str) -> DataFrame:
    """(dataset, cluster, size): composite_top_quartile, smallest (half rounded down, at least 2), random (all) or
    hard (nearest half)."""
    w = W.partitionBy("dataset")
    half = F.greatest(F.lit(2), F.floor(F.count(F.lit(1)).over(w) / 2))
    if selection == "composite_top_quartile":
        keep = F.col("composite") >= F.percentile("composite", 0.75).over(w)
    elif selection == "smallest":
        keep = F.row_number().over(w.orderBy("size", "cluster")) <= half
    elif selection == "hard":
        keep = F.row_number().over(w.orderBy("far_component", "cluster")) <= half
    else:
        keep = F.lit(True)
    return clusters.withColumn("_k", keep).where("_k").select("dataset", "cluster", "size")


def draw_subsets(chosen: DataFrame, totals: DataFrame, n_subsets: int, seed: object, least: int = 20, share: float = 0.05) -> DataFrame:
    """(dataset, subset, cluster): shuffled candidate clusters, added while those before hold fewer than the target rows.

    totals: (dataset, n). The target is max(least, floor(share * n)). The table is subsets times clusters, never rows.
    """
    s = chosen.withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(n_subsets - 1))))
    w = W.partitionBy("dataset", "subset").orderBy(draw_order(seed, "dataset", "subset", "cluster"))
    before = F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return s.withColumn("_b", before).join(totals, "dataset").where(F.col("_b") < F.greatest(F.lit(least), F.floor(F.col("n") * share))).select("dataset", "subset", "cluster")


def memberships(rows: DataFrame, drawn: DataFrame, n_subsets: int, seed: object) -> DataFrame:
    """(dataset, subset, row_id, role): rows of drawn clusters are pseudo_anom; of the rest, in shuffled order, the last
    max(50, 20%), at most a third, are pseudo_norm, the others train."""
    s = rows.select("dataset", "row_id", "cluster").withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(n_subsets - 1))))
    s = s.join(drawn.withColumn("_a", F.lit(1)), ["dataset", "subset", "cluster"], "left").withColumn("_a", F.coalesce("_a", F.lit(0)))
    w = W.partitionBy("dataset", "subset", "_a")
    s = s.withColumn("_k", F.row_number().over(w.orderBy(draw_order(seed, "subset", "row_id")))).withColumn("_n", F.count(F.lit(1)).over(w))
    held = F.expr("least(greatest(50, floor(_n * 0.2)), floor(_n / 3))")
    role = F.when(F.col("_a") == 1, "pseudo_anom").when(F.col("_k") > F.col("_n") - held, "pseudo_norm").otherwise("train")
    return s.select("dataset", "subset", "row_id", role.alias("role"))


def roles_of(rows: DataFrame, chosen: DataFrame, by: list[str], seed: object, unused: DataFrame | None = None) -> DataFrame:
    """(dataset, by.., row_id, role): chosen (dataset, by.., row_id) are pseudo_anom; of a data set's others, in shuffled order,
    the last max(50, 20%), at most a third, are pseudo_norm and the rest train. Rows of ``unused`` (dataset, row_id) that are not
    chosen have no role."""
    keys = ["dataset", *by]
    s = rows.select("dataset", "row_id").join(chosen.select(*keys).distinct(), "dataset")
    s = s.join(chosen.select(*keys, "row_id", F.lit(1).alias("_a")), [*keys, "row_id"], "left").withColumn("_a", F.coalesce("_a", F.lit(0)))
    if unused is not None:
        s = s.join(unused.select("dataset", "row_id", F.lit(True).alias("_u")), ["dataset", "row_id"], "left").where("_a = 1 OR _u IS NULL").drop("_u")
    w = W.partitionBy(*keys, "_a")
    s = s.withColumn("_k", F.row_number().over(w.orderBy(draw_order(seed, *by, "row_id")))).withColumn("_n", F.count(F.lit(1)).over(w))
    held = F.expr("least(greatest(50, floor(_n * 0.2)), floor(_n / 3))")
    role = F.when(F.col("_a") == 1, "pseudo_anom").when(F.col("_k") > F.col("_n") - held, "pseudo_norm").otherwise("train")
    return s.select(*keys, "row_id", role.alias("role"))


def tail_subsets(rows: DataFrame, pool: DataFrame, n_subsets: int, seed: object, target: float = 0.05) -> DataFrame:
    """(dataset, subset, row_id, role): in each subset max(20, ``target`` of the rows) are drawn from the pool (dataset, row_id) of
    tail rows as pseudo-anomalies; the rest of the pool takes no part."""
    size = rows.groupBy("dataset").agg(F.greatest(F.lit(20), F.floor(F.count(F.lit(1)) * target)).alias("_t"))
    s = pool.join(size, "dataset").withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(n_subsets - 1))))
    place = F.row_number().over(W.partitionBy("dataset", "subset").orderBy(draw_order(seed, "subset", "row_id")))
    drawn = s.withColumn("_k", place).where(F.col("_k") <= F.col("_t")).select("dataset", "subset", "row_id")
    return roles_of(rows, drawn, ["subset"], seed, pool)


def regrets(pseudo: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """(dataset, by.., picked, regret, random_regret): the detector of the highest mean pseudo-AUC, ties by name, against the best."""
    m = pseudo.groupBy("dataset", *by, "detector").agg(F.round(F.avg("pseudo_auc"), 9).alias("_p")).where("_p IS NOT NULL")
    m = m.join(truth.select("dataset", "detector", "true_auc").where("true_auc IS NOT NULL"), ["dataset", "detector"])
    best = m.groupBy("dataset", *by).agg(F.min(F.struct((-F.col("_p")).alias("p"), "detector", "true_auc")).alias("b"), F.max("true_auc").alias("_max"), F.avg("true_auc").alias("_avg"))
    return best.select("dataset", *by, F.col("b.detector").alias("picked"), (F.col("_max") - F.col("b.true_auc")).alias("regret"), (F.col("_max") - F.col("_avg")).alias("random_regret"))


def graded(rows: DataFrame, members: DataFrame, features: tuple[str, ...], names: list[str], by: list[str], positive: str, digits: int = 9) -> DataFrame:
    """(by, detector, n_train, n_pos, n_neg, auc, ap): each detector fitted on a unit's train rows and graded on its others.

    members (by.., row_id, role): the units, subsets or regimes of data sets, are data sets of their own to the detectors, so
    one plan fits and scores all of them. ``positive`` is the role that counts as anomalous; roles other than that and train
    count as normal. Scores are rounded to ``digits``, so that ties do not hang on the order of sums. A detector that fails on
    a unit, or a unit without both classes, has no AUC.
    """
    from siftlake.operators.detectors import fit_and_score, pool

    # a stored table of roles is packed a hundred times as tight as its rows are in memory, and the planner goes by the former:
    # without the hints it may be broadcast
    m = stored(members.withColumn("_d", F.concat_ws("/", *by)), "members")
    wide = rows.select("dataset", "row_id", *features).hint("merge").join(m.select("dataset", "row_id", "_d", "role").hint("merge"), ["dataset", "row_id"])
    units = stored(wide.drop("dataset").withColumnRenamed("_d", "dataset"), "units")
    train, held = (units.where(c).select("dataset", "row_id", *features) for c in ("role = 'train'", "role <> 'train'"))
    scores = fit_and_score(train, held, features, names).withColumn("score", F.round("score", digits))
    label = m.where("role <> 'train'").select("_d", "row_id", (F.col("role") == positive).cast("int").alias("y"))
    s = scores.withColumnRenamed("dataset", "_d").hint("merge").join(label.hint("merge"), ["_d", "row_id"])
    grades = M.roc_auc(s, ["_d", "detector"]).join(M.average_precision(s, ["_d", "detector"]), ["_d", "detector"]).select("_d", "detector", "auc", "ap")
    counts = [F.sum((F.col("role") == "train").cast("int")).alias("n_train"), F.sum((F.col("role") == positive).cast("int")).alias("n_pos"), F.sum((~F.col("role").isin("train", positive)).cast("int")).alias("n_neg")]
    sizes = m.groupBy(*by, "_d").agg(*counts).withColumn("detector", F.explode(F.array(*[F.lit(n) for n in pool(names)])))
    return sizes.join(grades, ["_d", "detector"], "left").drop("_d")


def pseudo_auc(rows: DataFrame, members: DataFrame, features: tuple[str, ...], names: list[str], by: tuple[str, ...] = ("dataset", "subset"), digits: int = 9) -> DataFrame:
    """(by, detector, n_train, n_anom, n_norm, pseudo_auc): each detector, fitted on a subset's train rows alone, separates
    its pseudo-anomalies from its pseudo-normals."""
    g = graded(rows, members, features, names, list(by), "pseudo_anom", digits)
    return g.select(*by, "detector", "n_train", F.col("n_pos").alias("n_anom"), F.col("n_neg").alias("n_norm"), F.col("auc").alias("pseudo_auc"))


def synthetic_quality(normals: DataFrame, synthetic: DataFrame, features: tuple[str, ...], names: list[str], by: list[str], seed: object, held: float = 0.3, digits: int = 9) -> DataFrame:
    """(dataset, by.., detector, n_train, n_pos, n_neg, auc): each detector, fitted on the normals that ``held_out`` leaves, separates
    the synthetic rows (dataset, by.., k, features) of a unit from the held-out normals.

    Synthetic rows become rows of their own with negative ids: k and the unit's place in its data set make them unique.
    """
    keys = ["dataset", *by]
    units = synthetic.select(*keys).distinct()
    units = units.withColumn("_u", F.row_number().over(W.partitionBy("dataset").orderBy(*by))).withColumn("_all", F.count(F.lit(1)).over(W.partitionBy("dataset")))
    units = stored(units, "synthetic-units")  # a row for each unit
    made = synthetic.join(units, keys).withColumn("row_id", -(1 + F.col("k") * F.col("_all") + F.col("_u")).cast("bigint"))
    made = stored(made.select(*keys, "row_id", *features), "synthetic-rows")
    role = F.when(held_out(seed, held), "pseudo_norm").otherwise("train").alias("role")
    own = units.select(*keys).join(normals.select("dataset", "row_id", role), "dataset").select(*keys, "row_id", "role")
    members = own.unionByName(made.select(*keys, "row_id", F.lit("pseudo_anom").alias("role")))
    rows = normals.select("dataset", F.col("row_id").cast("bigint").alias("row_id"), *features).unionByName(made.select("dataset", "row_id", *features))
    return graded(rows, members, features, names, keys, "pseudo_anom", digits).select(*keys, "detector", "n_train", "n_pos", "n_neg", "auc")


def held_out(seed: object, share: float) -> Column:
    """Is a row, by the hash of its id, among the ``share`` that is kept from the fit."""
    return F.conv(F.substring(draw_order(seed, "row_id"), 1, 8), 16, 10).cast("double") < share * 4294967296.0


def true_roles(rows: DataFrame, seed: object) -> DataFrame:
    """(dataset, row_id, role): the first 80 % of the normals in a hash order train; the others are test, anomalies anom."""
    w = W.partitionBy("dataset", "y")
    place = F.row_number().over(w.orderBy(draw_order(seed, "row_id")))
    role = F.when(F.col("y") == 1, "anom").when(F.col("_k") <= F.floor(F.col("_n") * 0.8), "train").otherwise("test")
    return rows.withColumn("_k", place).withColumn("_n", F.count(F.lit(1)).over(w)).select("dataset", "row_id", role.alias("role"))


def true_quality(rows: DataFrame, features: tuple[str, ...], names: list[str], seed: object, digits: int = 9) -> DataFrame:
    """(dataset, detector, true_auc, true_ap): each detector, fitted on 80 % of the normals, on the others and all anomalies.

    The only place where labels are read."""
    g = graded(rows, true_roles(rows, seed), features, names, ["dataset"], "anom", digits)
    return g.select("dataset", "detector", F.col("auc").alias("true_auc"), F.col("ap").alias("true_ap"))


def subset_quality(rows: DataFrame, members: DataFrame, features: tuple[str, ...], names: list[str], digits: int = 9) -> DataFrame:
    """(dataset, detector, quality, subsets): mean pseudo-AUC over the usable subsets of a data set's normals."""
    usable = members.join(usable_subsets(members), ["dataset", "subset"], "left_semi")
    a = pseudo_auc(rows, usable, features, names, digits=digits)
    return a.groupBy("dataset", "detector").agg(F.avg("pseudo_auc").alias("quality"), F.count("pseudo_auc").alias("subsets")).where("subsets > 0")


def regime_scores(rows: DataFrame, clustered: dict[int, DataFrame], selections: tuple[str, ...], features: tuple[str, ...], names: list[str], n_subsets: int, seed: object, digits: int = 9) -> DataFrame:
    """(dataset, regime, detector, pseudo_auc, subsets): every selection over every clustering, by its K, as one plan."""
    from siftlake.operators.space import composite_scores

    parts = []
    for k, g in clustered.items():
        g = stored(g, "clusters")
        totals, scores = g.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")), stored(composite_scores(g), "composites")
        for s in selections:
            drawn = draw_subsets(candidates(scores, s), totals, n_subsets, seed)
            parts.append(memberships(g, drawn, n_subsets, seed).withColumn("regime", F.lit(f"{s}_K{k}")))
    members = parts[0]
    for p in parts[1:]:
        members = members.unionByName(p)
    a = pseudo_auc(rows, members, features, names, ("dataset", "regime", "subset"), digits)
    return a.groupBy("dataset", "regime", "detector").agg(F.avg("pseudo_auc").alias("pseudo_auc"), F.count("pseudo_auc").alias("subsets"))


def v1_ranking(pseudo: DataFrame, truth: DataFrame) -> DataFrame:
    """(dataset, detector, mean_pseudo_auc, pseudo_rank, true_auc, true_rank, rho): the mean over subsets ranks the detectors,
    and rho is the data set's rank correlation with the true ranking."""
    m = pseudo.groupBy("dataset", "detector").agg(F.round(F.avg("pseudo_auc"), 9).alias("mean_pseudo_auc"))
    m = m.join(truth.select("dataset", "detector", "true_auc"), ["dataset", "detector"]).where("mean_pseudo_auc IS NOT NULL AND true_auc IS NOT NULL")
    m = m.withColumn("pseudo_rank", average_rank(["dataset"], "mean_pseudo_auc", descending=True)).withColumn("true_rank", average_rank(["dataset"], "true_auc", descending=True))
    return m.join(m.groupBy("dataset").agg(F.corr("pseudo_rank", "true_rank").alias("rho")), "dataset")


def geometry_baseline(members: DataFrame, centre_distance: DataFrame, detectors: DataFrame) -> DataFrame:
    """(dataset, detector, score, tied): the held-out rows' mean distance, the same for every detector, as a control."""
    g = members.where("role = 'pseudo_anom'").join(centre_distance, ["dataset", "row_id"]).groupBy("dataset").agg(F.avg("distance").alias("score"))
    return g.crossJoin(F.broadcast(detectors)).withColumn("tied", F.lit(True))  # detectors: the registered pool


def regimes(selections: tuple[str, ...], ks: tuple[int, ...], spark) -> DataFrame:
    """(regime, selection, k) of the bank."""
    return spark.createDataFrame([(f"{s}_K{k}", s, k) for s in selections for k in ks], "regime string, selection string, k int")


def global_tail(rows: DataFrame, features: tuple[str, ...], share: float = 0.25, centroid: bool = False) -> DataFrame:
    """(dataset, row_id): the rows with the largest mean absolute z-score, or the farthest from the centre in z-scores."""
    w = W.partitionBy("dataset")
    scaled = [(F.col(f) - F.avg(f).over(w)) / (F.stddev_pop(f).over(w) + 1e-9) for f in features]
    z = F.sqrt(sum((x * x for x in scaled), F.lit(0.0))) if centroid else sum((F.abs(x) for x in scaled), F.lit(0.0)) / len(features)
    return rows.withColumn("_z", F.round(z, 9)).withColumn("_p", F.percent_rank().over(w.orderBy(F.col("_z").desc(), "row_id"))).where(F.col("_p") < share).select("dataset", "row_id")


def marginal_tail(long: DataFrame, n_banks: int, seed: object, share: float = 0.05) -> DataFrame:
    """(dataset, bank, row_id): for each bank a hash-drawn feature and side, and its extreme rows."""
    names = long.select("dataset", "feature").distinct().withColumn("bank", F.explode(F.sequence(F.lit(0), F.lit(n_banks - 1))))
    pick = names.withColumn("_o", draw_order(seed, "dataset", "bank", "feature"))
    pick = pick.withColumn("_k", F.row_number().over(W.partitionBy("dataset", "bank").orderBy("_o"))).where("_k = 1")
    pick = pick.withColumn("low", F.conv(F.substring("_o", 32, 1), 16, 10).cast("int") % 2 == 0).select("dataset", "bank", "feature", "low")
    cut = long.groupBy("dataset", "feature").agg(F.percentile("value", share).alias("lo"), F.percentile("value", 1 - share).alias("hi"))
    return long.join(pick, ["dataset", "feature"]).join(cut, ["dataset", "feature"]).where(F.expr("CASE WHEN low THEN value <= lo ELSE value >= hi END")).select("dataset", "bank", "row_id")


def contaminate(rows: DataFrame, rates: tuple[float, ...], seed: object) -> DataFrame:
    """(dataset, rate, row_id, y): all normals, and hash-drawn anomalies up to rate times their number; -1 takes all."""
    w = W.partitionBy("dataset", "y").orderBy(draw_order(seed, "row_id"))
    n = F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).over(W.partitionBy("dataset"))
    s = rows.select("dataset", "row_id", "y", F.row_number().over(w).alias("_k"), n.alias("_n")).withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    return s.where("y = 0 OR rate < 0 OR _k <= floor(rate * _n)").select("dataset", "rate", "row_id", "y")


def usable_subsets(members: DataFrame, least_rows: int = 60, least_side: int = 3, least_train: int = 20) -> DataFrame:
    """(dataset, subset): subsets large enough to grade on."""
    g = members.groupBy("dataset", "subset").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("role") == r, 1).otherwise(0)).alias(c) for r, c in (("train", "t"), ("pseudo_anom", "a"), ("pseudo_norm", "m"))])
    return g.where((F.col("n") >= least_rows) & (F.col("a") >= least_side) & (F.col("m") >= least_side) & (F.col("t") >= least_train)).select("dataset", "subset")


def edge_tags(rows: DataFrame) -> DataFrame:
    """(dataset, row_id, distance, share): distance to the own cluster's centre, and its rank within the cluster.

    Centres are averages by coordinate, joined back: no cluster is gathered.
    """
    c = rows.select("dataset", "cluster", F.posexplode("z").alias("i", "v")).groupBy("dataset", "cluster", "i").agg(F.avg("v").alias("m"))
    c = c.groupBy("dataset", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    d = rows.join(c, ["dataset", "cluster"]).withColumn("distance", F.expr("sqrt(aggregate(zip_with(c, z, (u, v) -> (u - v) * (u - v)), 0.0D, (s, t) -> s + t))"))
    return d.withColumn("share", F.percent_rank().over(W.partitionBy("dataset", "cluster").orderBy(F.round("distance", 9), "row_id"))).select("dataset", "row_id", "cluster", "distance", "share")


def edge_measures(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """(dataset, cluster, size, centroid, outer, marginal, recon): how far each cluster of (dataset, row_id, cluster, features) lies out.

    centroid is the distance of its mean in deviations over the root of the number of features; outer the share of its rows
    beyond the 90th percentile of all distances; marginal the mean, over features, of twice the distance from a half of
    the share of rows below its mean; recon its squared error over that of the other rows, when half of the principal axes of the
    others stand for a row. Errors come from sums of products, one aggregation by cluster: those of the others are the data
    set's less the cluster's.
    """
    names, d = list(features), len(features)
    axes = max(1, min(d - 1, d // 2))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = stored(rows.select("dataset", "row_id", "cluster", *[F.col(f).cast("double").alias(f) for f in names]), "measured")
    stats = x.groupBy("dataset").agg(*[F.struct(F.avg(f).alias("m"), (F.stddev_pop(f) + 1e-9).alias("s")).alias(f"_{f}") for f in names])
    far = F.sqrt(sum((F.pow((F.col(f) - F.col(f"_{f}.m")) / F.col(f"_{f}.s"), 2) for f in names), F.lit(0.0)))
    dist = x.join(stats, "dataset").select("dataset", "cluster", F.round(far, 9).alias("r"))
    cut = dist.groupBy("dataset").agg(F.percentile("r", 0.9).alias("cut"))
    outer = dist.join(cut, "dataset").groupBy("dataset", "cluster").agg(F.avg(F.when(F.col("r") > F.col("cut"), 1.0).otherwise(0.0)).alias("outer"))
    sums = [F.count(F.lit(1)).alias("size"), F.array(*[F.sum(f) for f in names]).alias("first"), F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]).alias("second")]
    own = stored(x.groupBy("dataset", "cluster").agg(*sums), "sums")
    added = [F.array(*[F.sum(F.col(c)[k]) for k in range(n)]).alias(f"all_{c}") for c, n in (("first", d), ("second", len(pairs)))]
    both = own.join(own.groupBy("dataset").agg(F.sum("size").alias("all_size"), *added), "dataset")

    @F.pandas_udf("double")
    def ratio(size: pd.Series, first: pd.Series, second: pd.Series, n: pd.Series, all_first: pd.Series, all_second: pd.Series) -> pd.Series:
        out = []
        for c, f, s, m, g, t in zip(size, first, second, n, all_first, all_second, strict=True):
            if m - c < 2:
                out.append(None)
                continue
            square = np.zeros((2, d, d))
            for k, v in enumerate((np.asarray(s) / c, (np.asarray(t) - np.asarray(s)) / (m - c))):
                square[k][tuple(np.array(pairs).T)] = v
                square[k] += square[k].T - np.diag(np.diag(square[k]))
            mean, own_mean = (np.asarray(g) - np.asarray(f)) / (m - c), np.asarray(f) / c
            spread = square[1] - np.outer(mean, mean)
            about = square[0] - np.outer(own_mean, mean) - np.outer(mean, own_mean) + np.outer(mean, mean)
            lost = np.linalg.eigh(spread)[1][:, : d - axes]  # what the largest axes leave out
            out.append(float(np.trace(lost.T @ about @ lost) / (np.trace(lost.T @ spread @ lost) + 1e-12)))
        return pd.Series(out, dtype=float)

    centre = [F.pow((F.col("first")[i] / F.col("size") - F.col(f"_{f}.m")) / F.col(f"_{f}.s"), 2) for i, f in enumerate(names)]
    out = both.join(stats, "dataset").select("dataset", "cluster", "size", F.sqrt(sum(centre, F.lit(0.0)) / d).alias("centroid"), ratio("size", "first", "second", "all_size", "all_first", "all_second").alias("recon"))
    means = own.select("dataset", "cluster", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.round(F.col("first")[i] / F.col("size"), 9).alias("v")) for i, f in enumerate(names)])).alias("e")).select("dataset", "cluster", "e.*")
    values = x.select("dataset", F.lit(None).cast(own.schema["cluster"].dataType).alias("cluster"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f, 9).alias("v")) for f in names])).alias("e")).select("dataset", "cluster", "e.*")
    counts = values.groupBy("dataset", "feature", "v").agg(F.count(F.lit(1)).alias("c")).select("dataset", F.lit(None).cast(own.schema["cluster"].dataType).alias("cluster"), "feature", "v", "c")
    w = W.partitionBy("dataset", "feature")  # over distinct values
    upto = F.sum("c").over(w.orderBy("v").rangeBetween(W.unboundedPreceding, 0)) - F.sum("c").over(W.partitionBy("dataset", "feature", "v"))
    below = counts.unionByName(means.withColumn("c", F.lit(0).cast("bigint"))).withColumn("share", upto / F.sum("c").over(w)).where("cluster IS NOT NULL")
    marginal = below.groupBy("dataset", "cluster").agg((2 * F.avg(F.abs(F.col("share") - 0.5))).alias("marginal"))
    return out.join(outer, ["dataset", "cluster"]).join(marginal, ["dataset", "cluster"])


def two_channels(tags: DataFrame, small: DataFrame, edge: float = 0.9) -> DataFrame:
    """(dataset, row_id, channel): peripheral rows of any cluster, or all rows of small clusters; embedded ones otherwise."""
    t = tags.join(small.select("dataset", "cluster", F.lit(True).alias("_s")), ["dataset", "cluster"], "left")
    return t.select("dataset", "row_id", F.when(F.col("share") >= edge, "peripheral").when(F.col("_s"), "small").otherwise("embedded").alias("channel"))


def mixed_regret(regrets: DataFrame, weight: float) -> DataFrame:
    """(dataset, regret): the two channels' regrets mixed."""
    return regrets.groupBy("dataset").agg((weight * F.sum(F.when(F.col("channel") == "peripheral", F.col("regret"))) + (1 - weight) * F.sum(F.when(F.col("channel") == "embedded", F.col("regret")))).alias("regret"))


def smallest_cluster(rows: DataFrame) -> DataFrame:
    """(dataset, row_id): the members of the smallest cluster, ties by number."""
    s = rows.groupBy("dataset", "cluster").agg(F.count(F.lit(1)).alias("n"))
    s = s.withColumn("_k", F.row_number().over(W.partitionBy("dataset").orderBy("n", "cluster"))).where("_k = 1")
    return rows.join(s.select("dataset", "cluster"), ["dataset", "cluster"], "left_semi").select("dataset", "row_id")


def farthest(rows: DataFrame, features: tuple[str, ...], share: float = 0.05) -> DataFrame:
    """(dataset, row_id): the share of rows farthest from the mean in standardised features."""
    w = W.partitionBy("dataset")
    d = sum((F.pow((F.col(f) - F.avg(f).over(w)) / (F.stddev_pop(f).over(w) + 1e-9), 2) for f in features), F.lit(0.0))
    return rows.withColumn("_d", F.round(d, 6)).withColumn("_q", F.percentile("_d", 1 - share).over(w)).where("_d >= _q").select("dataset", "row_id")


def void_holdout(rows: DataFrame, features: tuple[str, ...], kind: str = "knn", size: int = 20, n: int = 3, seed: object = 0, seeds: DataFrame | None = None) -> DataFrame:
    """(dataset, void, row_id): ``n`` local hold-outs: a seed and its ``size`` neighbours (knn), disjoint balls of that size
    where rows are densest (dense), or disjoint balls of the seeds' median radius (radius).

    ``seeds`` (dataset, row_id) are the rows that may be a centre, all of ``rows`` if not given; only they are compared with
    every row. Each void is one round: the first seed that no void holds yet, and the rows within its radius. A round's centre
    is one row for each data set, so its join with the rows shuffles nothing.
    """
    from siftlake.operators.space import neighbours, standardise

    z = standardise(rows, features).select("dataset", "row_id", *features)
    asked = z if seeds is None else z.join(seeds, ["dataset", "row_id"], "left_semi")
    far = neighbours(asked, z, features, size).groupBy("dataset", "row_id").agg(F.max("distance").alias("radius"))
    asked = stored(asked.join(far, ["dataset", "row_id"]), "seeds")
    order = F.col("radius") if kind == "dense" else draw_order(seed, "dataset", "row_id")
    asked = asked.withColumn("_o", order.cast("string") if kind != "dense" else order)
    if kind == "radius":
        asked = asked.join(asked.groupBy("dataset").agg(F.percentile("radius", 0.5).alias("_r")), "dataset").withColumn("radius", F.col("_r")).drop("_r")
    out = None
    for k in range(n):
        free = asked if out is None else asked.join(out, ["dataset", "row_id"], "left_anti")
        first = free.groupBy("dataset").agg(F.min(F.struct("_o", "row_id", "radius", *features)).alias("c"))
        distance = F.sqrt(sum(((F.col(f) - F.col(f"c.{f}")) * (F.col(f) - F.col(f"c.{f}")) for f in features), F.lit(0.0)))
        ball = z.join(F.broadcast(first), "dataset").where(distance <= F.col("c.radius"))
        if kind != "knn" and out is not None:
            ball = ball.join(out, ["dataset", "row_id"], "left_anti")
        ball = ball.select("dataset", F.lit(k).alias("void"), "row_id")
        out = ball if out is None else out.unionByName(ball)
        out = stored(out.select("dataset", "void", "row_id"), "voids")
    return out


def displace(rows: DataFrame, held: DataFrame, features: tuple[str, ...], steps: tuple[float, ...] = (0, 0.5, 1, 2, 4), valid: bool = False) -> DataFrame:
    """(dataset, delta, row_id, features): held-out rows moved outward by delta deviations; ``valid`` clips to the range."""
    s = rows.groupBy("dataset").agg(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s"), F.min(f).alias("lo"), F.max(f).alias("hi")).alias(f"_{f}") for f in features])
    h = rows.join(held, ["dataset", "row_id"], "left_semi").join(s, "dataset").withColumn("delta", F.explode(F.array(*[F.lit(float(d)) for d in steps])))
    moved = []
    for f in features:
        v = F.col(f) + F.signum(F.col(f) - F.col(f"_{f}.m")) * F.col("delta") * F.col(f"_{f}.s")
        moved.append((F.least(F.greatest(v, F.col(f"_{f}.lo")), F.col(f"_{f}.hi")) if valid else v).alias(f))
    return h.select("dataset", "delta", "row_id", *moved)
