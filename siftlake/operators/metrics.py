"""Quality of scores against labels, and of detectors against each other.

Scores arrive long: ``by`` columns name the unit (data set, detector), ``score`` is larger for more anomalous rows and ``y``
is 1 for anomalies. Every metric first adds up labels by distinct score, a partial aggregation before any window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions.ranks import average_rank, running_totals

SCORE_GRID = 1000


def by_score(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """(by, score, pos, neg): labels added up for each distinct score; NULL scores or labels are left out."""
    ok = df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
    return ok.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"))


def roc_auc(df: DataFrame, by: list[str], score: str = "score", y: str = "y", splits: int | None = None) -> DataFrame:
    """(by, auc): share of anomaly-normal pairs in the right order, ties a half; NULL with one class only."""
    r = running_totals(by_score(df, by, score, y), by, "score", ["pos", "neg"], splits)
    # an anomaly beats the normals with smaller scores and half of those with its own
    won = F.sum(F.col("pos") * (F.col("all_neg") - F.col("cum_neg") + F.col("neg") / 2.0))
    return r.groupBy(*by).agg(won.alias("w"), F.max("all_pos").alias("p"), F.max("all_neg").alias("n")).select(*by, F.expr("CASE WHEN p > 0 AND n > 0 THEN w / (cast(p as double) * n) END").alias("auc"))


def average_precision(df: DataFrame, by: list[str], score: str = "score", y: str = "y", splits: int | None = None) -> DataFrame:
    """(by, ap, base_rate): precision at each distinct score, weighted by the recall it adds; NULL without anomalies."""
    r = running_totals(by_score(df, by, score, y), by, "score", ["pos", "neg"], splits)
    step = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    out = r.groupBy(*by).agg(step.alias("s"), F.max("all_pos").alias("p"), F.max("all_neg").alias("n"))
    return out.select(*by, F.expr("CASE WHEN p > 0 THEN s / p END").alias("ap"), F.expr("p / (p + n)").alias("base_rate"))


def normalised(ap: Column, base_rate: Column, epsilon: float = 0.0) -> Column:
    """(ap - r) / (1 - r): 0 for random order, 1 for perfect. NULL where r is 1, unless ``epsilon`` is added."""
    return F.try_divide(ap - base_rate, 1 - base_rate + F.lit(epsilon))


def partial_auc(df: DataFrame, by: list[str], limit: float = 0.1, score: str = "score", y: str = "y") -> DataFrame:
    """(by, pauc): area under the ROC curve up to a false-positive rate, standardised so that 0.5 is chance."""
    r = running_totals(by_score(df, by, score, y), by, "score", ["pos", "neg"]).where("all_pos > 0 AND all_neg > 0")
    r = r.select(*by, F.expr("(cum_neg - neg) / all_neg").alias("x0"), F.expr("cum_neg / all_neg").alias("x1"), F.expr("(cum_pos - pos) / all_pos").alias("t0"), F.expr("cum_pos / all_pos").alias("t1"))
    r = r.where(F.col("x0") < limit).withColumn("x", F.least("x1", F.lit(limit)))
    cut = F.expr("CASE WHEN x1 > x0 THEN t0 + (t1 - t0) * (x - x0) / (x1 - x0) ELSE t1 END")
    area = F.sum((F.col("x") - F.col("x0")) * (F.col("t0") + cut) / 2.0)
    least = limit * limit / 2
    return r.groupBy(*by).agg((0.5 * (1 + (area - least) / (limit - least))).alias("pauc"))


def precision_at_n(df: DataFrame, by: list[str], tie: str, score: str = "score", y: str = "y") -> DataFrame:
    """(by, p_at_n, lift_at_n): share of anomalies among the n highest scores, n the number of anomalies."""
    w = W.partitionBy(*by)
    ranked = df.withColumn("_k", F.row_number().over(w.orderBy(F.col(score).desc(), tie))).withColumn("_p", F.sum(y).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    top = ranked.where("_k <= _p").groupBy(*by).agg(F.avg(y).alias("p_at_n"), F.max(F.col("_p") / F.col("_n")).alias("_r"))
    return top.select(*by, "p_at_n", (F.col("p_at_n") / F.col("_r")).alias("lift_at_n"))


def recall_at_rates(df: DataFrame, calibration: DataFrame, by: list[str], rates: tuple[float, ...] = (0.01, 0.05)) -> DataFrame:
    """(by, recall_1, recall_5): anomalies strictly above the calibration normals' 1 - rate quantile."""
    cuts = calibration.groupBy(*by).agg(*[F.percentile("score", 1 - r).alias(f"_q{k}") for k, r in enumerate(rates)])
    hit = [F.avg(F.when(F.col("score") > F.col(f"_q{k}"), 1.0).otherwise(0.0)).alias(f"recall_{round(100 * r)}") for k, r in enumerate(rates)]
    return df.where("y = 1").join(cuts, by).groupBy(*by).agg(*hit)


def recall_at_rate(df: DataFrame, by: list[str], rate: float = 0.1, splits: int | None = None) -> DataFrame:
    """(by, recall): the ROC curve's true-positive rate at a false-positive rate, on the line between the points around it."""
    counts = df.where("score IS NOT NULL").groupBy(*by, "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    c = running_totals(counts, by, "score", ["pos", "neg"], splits)
    point = F.struct(F.try_divide("cum_neg", "all_neg").alias("x"), F.try_divide("cum_pos", "all_pos").alias("y"))
    c = c.select(*by, point.alias("p")).where("p.x IS NOT NULL AND p.y IS NOT NULL")
    ends = c.groupBy(*by).agg(F.max(F.when(F.col("p.x") <= rate, F.col("p"))).alias("a"), F.min(F.when(F.col("p.x") > rate, F.col("p"))).alias("z"))
    x, y = F.coalesce("a.x", F.lit(0.0)), F.coalesce("a.y", F.lit(0.0))
    return ends.select(*by, F.coalesce(y + (rate - x) * (F.col("z.y") - y) / (F.col("z.x") - x), y).alias("recall"))


# --- excess mass and mass volume --------------------------------------------------------------------------------------


def _curve(values: np.ndarray, inside: np.ndarray, uniform: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of ascending score levels with counts: the shares of scores and of uniform points at or above each level."""
    return values, *(np.cumsum(c[::-1])[::-1] / max(1, c.sum()) for c in (inside, uniform))


def _levels(scores: np.ndarray, uniform: np.ndarray) -> tuple[np.ndarray, ...]:
    values, at = np.unique(np.concatenate([scores, uniform]), return_inverse=True)
    first = np.arange(len(at)) < len(scores)
    return _curve(values, np.bincount(at[first], minlength=len(values)), np.bincount(at[~first], minlength=len(values)))


def _excess(mass: np.ndarray, volume: np.ndarray) -> float:
    above, wide = (np.append(x[1:], 0.0) for x in (mass, volume))
    own = mass > above  # the thresholds are scores, not those of uniform points
    above, wide = above[own], wide[own]
    t = np.linspace(0, 100, SCORE_GRID)
    em = np.zeros(len(t))
    em[0] = 1.0
    for a in range(1, len(t), 128):
        em[a : a + 128] = np.maximum(0, (above[None, :] - t[a : a + 128, None] * wide[None, :]).max(axis=1))
    below = np.flatnonzero(em <= 0.9)
    end = int(below[0]) if len(below) and below[0] > 0 else len(t) - 1
    return float(np.trapezoid(em[: end + 1], t[: end + 1]))


def _smallest_volume(mass: np.ndarray, volume: np.ndarray) -> float:
    alphas = np.linspace(0.9, 0.999, SCORE_GRID)
    at = np.searchsorted(-mass, -alphas, side="right") - 1  # the highest level that still holds alpha of the scores
    return float(np.trapezoid(volume[np.maximum(at, 0)], alphas))


def excess_mass(scores: np.ndarray, uniform: np.ndarray) -> float:
    """Area under EM(t) = max over scores u of P(s > u) - t P_unif(s > u), up to where it first falls to 0.9."""
    return _excess(*_levels(scores, uniform)[1:])


def mass_volume(scores: np.ndarray, uniform: np.ndarray) -> float:
    """Area under the volume of the smallest level set of mass alpha, alpha from 0.9 to 0.999."""
    return _smallest_volume(*_levels(scores, uniform)[1:])


def _pooled(values: np.ndarray, mass: np.ndarray, volume: np.ndarray) -> tuple[float, float]:
    """EM over slopes 0 to 1 and MV over 50 masses, on 100 thresholds between the lowest and the highest score."""
    at = np.searchsorted(values, np.linspace(values[0], values[-1], 100), side="left")
    held, wide = (np.append(x, 0.0)[at] for x in (mass, volume))
    slopes, alphas = np.linspace(0, 1, 100), np.linspace(0.9, 0.999, 50)
    best = (held - np.outer(slopes, wide)).max(axis=1)
    return float(np.trapezoid(best, slopes)), float(np.trapezoid(np.interp(alphas, held[::-1], wide[::-1]), alphas))


def mass_criteria(df: DataFrame, by: list[str], levels: int = 4096) -> DataFrame:
    """(by, em, mv, em_v1, mv_v1) from rows (by, score, uniform boolean). Normal scores count as the dense side.

    Scores are counted on ``levels`` steps of each unit's range before they are gathered, so a unit of any size is a group of
    that many rows.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    s = df.select(*by, (-F.col("score")).alias("s"), "uniform")
    ends = s.groupBy(*by).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    step = F.expr(f"CASE WHEN hi > lo THEN round((s - lo) / (hi - lo) * {levels - 1}) ELSE 0 END")
    s = s.join(ends, by).withColumn("level", step).groupBy(*by, "level", "lo", "hi")
    counts = s.agg(F.sum((~F.col("uniform")).cast("int")).alias("inside"), F.sum(F.col("uniform").cast("int")).alias("outside"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("level")
        values = pdf["lo"].to_numpy() + pdf["level"].to_numpy() * (pdf["hi"].to_numpy() - pdf["lo"].to_numpy()) / (levels - 1)
        inside, outside = pdf["inside"].to_numpy(), pdf["outside"].to_numpy()
        out = {c: [pdf[c].iloc[0]] for c in by}
        if not inside.sum() or not outside.sum():
            return pd.DataFrame(out | dict.fromkeys(("em", "mv", "em_v1", "mv_v1"), [None]))
        values, mass, volume = _curve(values, inside, outside)
        e1, m1 = _pooled(values, mass, volume)
        return pd.DataFrame(out | {"em": [_excess(mass, volume)], "mv": [_smallest_volume(mass, volume)], "em_v1": [e1], "mv_v1": [m1]})

    return counts.groupBy(*by).applyInPandas(run, f"{kinds}, em double, mv double, em_v1 double, mv_v1 double")


# --- agreement between detectors --------------------------------------------------------------------------------------


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, rho, n): correlation of average ranks; NULL for fewer than 3 rows or a constant side."""
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", average_rank(by, x)).withColumn("_y", average_rank(by, y))
    g = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_x", "_y").alias("c"), F.stddev_pop("_x").alias("sx"), F.stddev_pop("_y").alias("sy"))
    return g.select(*by, F.expr("CASE WHEN n >= 3 AND sx > 0 AND sy > 0 THEN c END").alias("rho"), "n")


def kendall(df: DataFrame, by: list[str], key: str, x: str, y: str) -> DataFrame:
    """(by, tau): tau-b over all pairs of a group's rows (a group is a pool of detectors, tens of rows)."""
    a = df.select(*by, F.col(key).alias("ka"), F.col(x).alias("xa"), F.col(y).alias("ya"))
    b = df.select(*by, F.col(key).alias("kb"), F.col(x).alias("xb"), F.col(y).alias("yb"))
    s = a.join(b, by).where("ka < kb").select(*by, F.expr("sign(xa - xb)").alias("u"), F.expr("sign(ya - yb)").alias("v"))
    g = s.groupBy(*by).agg(F.sum(F.col("u") * F.col("v")).alias("s"), F.sum(F.abs("u")).alias("nx"), F.sum(F.abs("v")).alias("ny"))
    return g.select(*by, F.expr("CASE WHEN nx > 0 AND ny > 0 THEN s / sqrt(nx * ny) END").alias("tau"))


def rank_guard(df: DataFrame, by: list[str], truth: str, guess: str) -> DataFrame:
    """(by, note): why a rank correlation would mean nothing, or an empty note."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.max(truth) - F.min(truth)).alias("st"), (F.max(guess) - F.min(guess)).alias("sg"))
    note = F.expr("CASE WHEN n < 3 THEN 'n<3' WHEN st < 1e-6 THEN 'true_all_tied' WHEN sg < 1e-6 THEN 'pred_all_tied' ELSE '' END")
    return g.select(*by, note.alias("note"))


def top_hits(df: DataFrame, by: list[str], key: str, truth: str, guess: str) -> DataFrame:
    """(by, top1_hit, top3_hit_ratio): do the best by guess and by truth agree; the ratio always divides by 3."""
    w = W.partitionBy(*by)
    r = df.withColumn("_t", F.row_number().over(w.orderBy(F.col(truth).desc(), key))).withColumn("_g", F.row_number().over(w.orderBy(F.col(guess).desc(), key)))
    return r.groupBy(*by).agg(F.max(F.expr("CASE WHEN _t = 1 AND _g = 1 THEN 1 ELSE 0 END")).alias("top1_hit"), (F.sum(F.expr("CASE WHEN _t <= 3 AND _g <= 3 THEN 1 ELSE 0 END")) / 3.0).alias("top3_hit_ratio"))


def pairwise_spearman(df: DataFrame, by: list[str], key: str, item: str, value: str) -> DataFrame:
    """(by, a, b, rho) for ordered pairs a <> b of ``key``: correlation of their ranks over ``item``."""
    r = df.withColumn("_r", average_rank([*by, key], value))
    a = r.select(*by, item, F.col(key).alias("a"), F.col("_r").alias("ra"))
    b = r.select(*by, item, F.col(key).alias("b"), F.col("_r").alias("rb"))
    return a.join(b, [*by, item]).where("a <> b").groupBy(*by, "a", "b").agg(F.corr("ra", "rb").alias("rho"))


def centrality(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, key, centrality): mean correlation with the others."""
    return pairs.groupBy(*by, F.col("a").alias("key")).agg(F.avg("rho").alias("centrality"))


def udr(df: DataFrame, by: list[str], key: str, item: str, value: str) -> DataFrame:
    """(by, key, udr): correlation of a detector's ranks with the ranks of the mean rank."""
    r = df.withColumn("_r", average_rank([*by, key], value))
    mean = r.groupBy(*by, item).agg(F.avg("_r").alias("_m")).withColumn("_c", average_rank(by, "_m"))
    return r.join(mean, [*by, item]).groupBy(*by, F.col(key).alias("key")).agg(F.corr("_r", "_c").alias("udr"))


def hits(pairs: DataFrame, by: list[str], steps: int = 100) -> DataFrame:
    """(by, key, authority): power iteration of the squared agreement matrix, negative agreement as none.

    A group is a pool of detectors, so its matrix is tens by tens.
    """
    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {k: i for i, k in enumerate(keys)}
        m = np.zeros((len(keys), len(keys)))
        m[[at[k] for k in pdf["a"]], [at[k] for k in pdf["b"]]] = np.clip(np.nan_to_num(pdf["rho"].to_numpy(float)), 0, None)
        v = np.ones(len(keys)) / np.sqrt(len(keys))
        for _ in range(steps):
            v = m.T @ (m @ v)
            v = v / max(np.linalg.norm(v), 1e-12)
        return pd.DataFrame({c: [pdf[c].iloc[0]] * len(keys) for c in by} | {"key": keys, "authority": v})

    return pairs.groupBy(*by).applyInPandas(run, f"{kinds}, key string, authority double")


def seed_agreement(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, agreement): median correlation between the seeds of one configuration, each pair once."""
    return pairs.where("a < b").groupBy(*by).agg(F.percentile("rho", 0.5).alias("agreement"))


# --- regret -----------------------------------------------------------------------------------------------------------


def regret(df: DataFrame, by: list[str], key: str, truth: str, guess: str) -> DataFrame:
    """(by, regret1, regret3, random_regret, worst_regret, norm_rank) of taking the best by ``guess``.

    regret3 takes the best of the first three; random is what a uniform pick loses on average; norm_rank is the pick's
    place by truth, 0 for the best and 1 for the last.
    """
    w = W.partitionBy(*by)
    r = df.withColumn("_g", F.row_number().over(w.orderBy(F.col(guess).desc_nulls_last(), key))).withColumn("_t", average_rank(by, truth, True)).withColumn("_n", F.count(F.lit(1)).over(w))
    best = F.max(truth)
    pick = F.max(F.when(F.col("_g") == 1, F.col(truth)))
    three = F.max(F.when(F.col("_g") <= 3, F.col(truth)))
    place = F.max(F.when(F.col("_g") == 1, F.expr("CASE WHEN _n > 1 THEN (_t - 1) / (_n - 1) ELSE 0.0 END")))
    return r.groupBy(*by).agg((best - pick).alias("regret1"), (best - three).alias("regret3"), (best - F.avg(truth)).alias("random_regret"), (best - F.min(truth)).alias("worst_regret"), place.alias("norm_rank"))


def nested_mean(df: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Mean of group means: macro over families, or balanced over sources."""
    means = df.groupBy(*outer, *inner).agg(F.avg(value).alias("_m"))
    return means.groupBy(*outer).agg(F.avg("_m").alias(value)) if outer else means.agg(F.avg("_m").alias(value))


def regret_shape(df: DataFrame, by: list[str], value: str, optimal: float = 0.01, bad: float = 0.3) -> DataFrame:
    """(by, mean, median, p90, worst, share_optimal, share_bad) of a regret column."""
    v = F.col(value)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.groupBy(*by).agg(F.avg(v).alias("mean_regret"), F.percentile(v, 0.5).alias("median_regret"), F.percentile(v, 0.9).alias("p90_regret"), F.max(v).alias("worst_regret"), share(v < optimal).alias("share_optimal"), share(v > bad).alias("share_bad"))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: Callable[[], Column] | Column) -> DataFrame:
    """(by, wmean): weighted by ``weight`` (NULL as 0), or the plain mean where all weights vanish."""
    w = F.coalesce(weight() if callable(weight) else weight, F.lit(0.0))
    g = df.where(F.col(value).isNotNull()).withColumn("_w", w).groupBy(*by).agg(F.sum("_w").alias("sw"), F.sum(F.col("_w") * F.col(value)).alias("sv"), F.avg(value).alias("m"))
    return g.select(*by, F.expr("CASE WHEN sw < 1e-12 THEN m ELSE sv / sw END").alias("wmean"))
