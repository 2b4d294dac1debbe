"""Rank aggregation and selection rules over grades (dataset, detector, ...); every pick breaks ties by detector name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions.ranks import average_rank, first_by, min_max, z_score
from siftlake.operators import metrics as M


def aggregate_ranks(pseudo: DataFrame, value: str = "pseudo") -> DataFrame:
    """(dataset, detector, aggregation, score, rank) by mean, borda (minus the mean of ranks) and varweight."""
    by = ["dataset", "detector"]
    ok = pseudo.where(F.col(value).isNotNull())
    r = ok.withColumn("_r", average_rank(["dataset", "subset"], value, True)).withColumn("_w", F.coalesce(F.var_samp(value).over(W.partitionBy("dataset", "subset")), F.lit(0.0)))
    g = r.groupBy(*by).agg(F.avg(value).alias("mean"), (-F.avg("_r")).alias("borda"), F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col(value)).alias("_sv"))
    g = g.withColumn("varweight", F.expr("CASE WHEN _sw < 1e-12 THEN mean ELSE _sv / _sw END"))
    parts = F.explode(F.array(*[F.struct(F.lit(a).alias("aggregation"), F.round(a, 9).alias("score")) for a in ("mean", "borda", "varweight")]))
    long = g.select(*by, parts.alias("p")).select(*by, "p.*")
    return long.withColumn("rank", average_rank(["dataset", "aggregation"], "score", True))


def regime_weights(scores: DataFrame, value: str = "pseudo", temperature: float = 0.01) -> DataFrame:
    """(dataset, regime, uniform, variance, stability, margin, product, softmax) from (dataset, regime, subset, detector, value)."""
    r = scores.withColumn("_r", average_rank(["dataset", "regime", "subset"], value, True))
    d = r.groupBy("dataset", "regime", "detector").agg(F.avg(value).alias("m"), F.coalesce(F.stddev_pop("_r"), F.lit(0.0)).alias("s"))
    w = W.partitionBy("dataset", "regime").orderBy(F.col("m").desc(), "detector")
    d = d.withColumn("_next", F.lead("m").over(w)).withColumn("_k", F.row_number().over(w))
    g = d.groupBy("dataset", "regime").agg(F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("variance"), (1 / (F.avg("s") + 1e-6)).alias("stability"), F.coalesce(F.max(F.when(F.col("_k") == 1, F.col("m") - F.col("_next"))), F.lit(0.0)).alias("margin"))
    e = F.exp((F.col("variance") - F.max("variance").over(W.partitionBy("dataset"))) / temperature)
    return g.withColumn("uniform", F.lit(1.0)).withColumn("product", F.col("variance") * F.col("stability")).withColumn("_e", e).withColumn("softmax", F.col("_e") / F.sum("_e").over(W.partitionBy("dataset"))).drop("_e")


def agreement_weights(scores: DataFrame, value: str = "score") -> DataFrame:
    """(dataset, regime, agreement): mean rank correlation with the other regimes, 0 at least."""
    p = M.pairwise_spearman(scores, ["dataset"], "regime", "detector", value)
    return p.groupBy("dataset", F.col("a").alias("regime")).agg(F.greatest(F.avg("rho"), F.lit(0.0)).alias("agreement"))


def combine(scores: DataFrame, weights: DataFrame, weight: str, how: str = "rank", value: str = "score") -> DataFrame:
    """(dataset, detector, score): weighted mean of ranks (negated) or z-scores, or 1000 times the top-1 votes plus Borda."""
    s = scores.join(weights.select("dataset", "regime", F.col(weight).alias("_w")), ["dataset", "regime"])
    s = s.withColumn("_r", average_rank(["dataset", "regime"], value, True))
    if how == "vote":
        top = F.row_number().over(W.partitionBy("dataset", "regime").orderBy(F.col(value).desc(), "detector")) == 1
        n = F.count(F.lit(1)).over(W.partitionBy("dataset", "regime"))
        return s.withColumn("_v", F.when(top, F.col("_w") * 1000).otherwise(0.0) + n - F.col("_r")).groupBy("dataset", "detector").agg(F.sum("_v").alias("score"))
    unit = -F.col("_r") if how == "rank" else F.coalesce(z_score(["dataset", "regime"], value), F.lit(0.0))
    s = s.withColumn("_u", unit)
    return s.groupBy("dataset", "detector").agg(F.expr("CASE WHEN sum(_w) < 1e-12 THEN avg(_u) ELSE sum(_w * _u) / sum(_w) END").alias("score"))


def debias(scores: DataFrame, alpha: float, value: str = "score") -> DataFrame:
    """(dataset, detector, score): alpha * min-max of the score + (1 - alpha) * min-max of its surprise, the z-score among
    all data sets' scores of that detector."""
    s = scores.withColumn("_z", F.coalesce(z_score(["detector"], value), F.lit(0.0)))
    mixed = alpha * min_max(["dataset"], F.col(value)) + (1 - alpha) * min_max(["dataset"], F.col("_z"))
    return s.select("dataset", "detector", mixed.alias("score"))


def confidence(scores: DataFrame, value: str = "score") -> DataFrame:
    """(dataset, top1_agreement, margin, mean_rho) of the regimes' rankings."""
    w = W.partitionBy("dataset", "regime").orderBy(F.col(value).desc(), "detector")
    t = scores.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead(value).over(w)).where("_k = 1")
    votes = t.groupBy("dataset", "detector").agg(F.count(F.lit(1)).alias("v"), F.sum(F.col(value) - F.col("_next")).alias("m"))
    g = votes.groupBy("dataset").agg((F.max("v") / F.sum("v")).alias("top1_agreement"), (F.sum("m") / F.sum("v")).alias("margin"))
    rho = M.pairwise_spearman(scores, ["dataset"], "regime", "detector", value).groupBy("dataset").agg(F.avg("rho").alias("mean_rho"))
    return g.join(rho, "dataset", "left")


def pick(grades: DataFrame, criterion: Column, ascending: bool = False, least: int = 3) -> DataFrame:
    """(dataset, detector): the best by a criterion, where at least ``least`` detectors have one."""
    g = grades.withColumn("_c", criterion).where(F.col("_c").isNotNull())
    g = g.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("dataset"))).where(F.col("_n") >= least)
    return first_by(g, ["dataset"], F.col("_c").asc() if ascending else F.col("_c").desc(), F.col("detector").asc()).select("dataset", "detector")


def best_fixed(grades: DataFrame, by: list[str], truth: str = "truth") -> DataFrame:
    """(by, detector): least mean regret, among the detectors that every data set of the group has."""
    g = grades.withColumn("_g", F.max(truth).over(W.partitionBy("dataset")) - F.col(truth))
    m = g.groupBy(*by, "detector").agg(F.round(F.avg("_g"), 9).alias("_m"), F.countDistinct("dataset").alias("_n"))
    m = m.withColumn("_x", F.max("_n").over(W.partitionBy(*by))).where("_n = _x")
    return first_by(m, by, F.col("_m").asc(), F.col("detector").asc()).select(*by, "detector")


def references(grades: DataFrame, truth: str = "truth") -> DataFrame:
    """(dataset, oracle_best, anti_oracle, random): the ends and the expectation of any selector."""
    return grades.groupBy("dataset").agg(F.max(truth).alias("oracle_best"), F.min(truth).alias("anti_oracle"), F.avg(truth).alias("random"))


def leverage(grades: DataFrame) -> DataFrame:
    """(dataset, lev): the best grade on typical probes less the best on extreme ones."""
    return grades.groupBy("dataset").agg((F.max("a1") - F.max("a4")).alias("lev"))


def matched_router(grades: DataFrame, threshold: float = -0.14) -> DataFrame:
    """(dataset, detector): best by a1 where the leverage is above the threshold, else by a4."""
    g = grades.withColumn("_l", F.max("a1").over(W.partitionBy("dataset")) - F.max("a4").over(W.partitionBy("dataset")))
    return pick(g, F.when(F.col("_l") > threshold, F.col("a1")).otherwise(F.col("a4")), least=1)


def alpha_router(grades: DataFrame, scale: float = 10.0) -> DataFrame:
    """(dataset, detector): best by a sigmoid mix of both grades."""
    w = W.partitionBy("dataset")
    s = 1 / (1 + F.exp(-scale * (F.max("a1").over(w) - F.max("a4").over(w))))
    return pick(grades.withColumn("_s", s), F.round(F.col("_s") * F.col("a1") + (1 - F.col("_s")) * F.col("a4"), 9), least=1)


def alpha_estimators(grades: DataFrame, alphas: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """(dataset, rule, detector) of four ways to choose the mix alpha * a1 + (1 - alpha) * a4.

    disagreement and margin take the best detector at the mix whose scores differ most (population deviation), or whose first
    leads the second by most, the smaller mix of equals; consensus the detector that is best at most mixes, by its smallest
    mix if equal; oracle the mix whose pick has the best truth.
    """
    s = grades.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    s = s.withColumn("_c", F.round(F.col("alpha") * F.col("a1") + (1 - F.col("alpha")) * F.col("a4"), 9))
    first = W.partitionBy("dataset", "alpha").orderBy(F.col("_c").desc(), "detector")
    every = W.partitionBy("dataset", "alpha")
    s = s.withColumn("_k", F.row_number().over(first)).withColumn("spread", F.round(F.stddev_pop("_c").over(every), 9)).withColumn("margin", F.round(F.col("_c") - F.lead("_c").over(first), 9))
    tops = s.where("_k = 1").select("dataset", "alpha", "detector", "spread", "margin", "truth")
    votes = tops.groupBy("dataset", "detector").agg(F.count(F.lit(1)).alias("_n"), F.min("alpha").alias("alpha"))
    chosen = {
        "disagreement": first_by(tops, ["dataset"], F.col("spread").desc(), F.col("alpha").asc()),
        "margin": first_by(tops, ["dataset"], F.col("margin").desc_nulls_last(), F.col("alpha").asc()),
        "consensus": first_by(votes, ["dataset"], F.col("_n").desc(), F.col("alpha").asc()),
        "oracle": first_by(tops, ["dataset"], F.col("truth").desc(), F.col("alpha").asc()),
    }
    parts = [c.select("dataset", F.lit(rule).alias("rule"), "detector") for rule, c in chosen.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return out


def learned_router(features: DataFrame, columns: tuple[str, ...], target: str, folds: int = 5) -> DataFrame:
    """(dataset, prediction): a small forest's out-of-fold prediction, folds by MD5 of the data set's name."""
    from functools import reduce

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    data = VectorAssembler(inputCols=list(columns), outputCol="features").transform(features).withColumn("_f", F.conv(F.substring(F.md5("dataset"), 1, 4), 16, 10).cast("int") % folds).cache()
    parts = []
    for k in range(folds):
        model = RandomForestRegressor(labelCol=target, numTrees=20, maxDepth=4, seed=k).fit(data.where(F.col("_f") != k))
        parts.append(model.transform(data.where(F.col("_f") == k)).select("dataset", "prediction"))
    return reduce(DataFrame.unionAll, parts)


def correlation_router(grades: DataFrame, structure: DataFrame, feature: str, leverage_above: float | None = None) -> DataFrame:
    """(dataset, detector): best by a1 where the structure feature is above the median over data sets, or, if given, the
    leverage above ``leverage_above``; else by a4."""
    middle = structure.agg(F.percentile(feature, 0.5).alias("_m"))  # one row
    route = structure.crossJoin(F.broadcast(middle)).select("dataset", (F.col(feature) > F.col("_m")).alias("_r"))
    if leverage_above is not None:
        route = route.join(leverage(grades), "dataset", "left").withColumn("_r", F.col("_r") | F.coalesce(F.col("lev") > leverage_above, F.lit(False)))
    return pick(grades.join(route, "dataset"), F.when(F.col("_r"), F.col("a1")).otherwise(F.col("a4")), least=1)


def few_shot_alpha(scores: DataFrame, alphas: tuple[float, ...], truth: DataFrame) -> DataFrame:
    """(dataset, alpha): the mix of a1 and a4 whose pick does best on a labelled share (dataset, detector, seen)."""
    s = scores.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas]))).withColumn("_c", F.round(F.col("alpha") * F.col("a1") + (1 - F.col("alpha")) * F.col("a4"), 9))
    best = first_by(s, ["dataset", "alpha"], F.col("_c").desc(), F.col("detector").asc()).select("dataset", "alpha", "detector").join(truth, ["dataset", "detector"])
    return first_by(best, ["dataset"], F.col("seen").desc(), F.col("alpha").asc()).select("dataset", "alpha")


def injection_borda(grades: DataFrame, value: str = "pseudo") -> DataFrame:
    """(dataset, borda_pick, mean_pick) over injection types in ``subset``."""
    r = grades.withColumn("_r", average_rank(["dataset", "subset"], value, True))
    g = r.groupBy("dataset", "detector").agg(F.round(F.sum("_r"), 9).alias("b"), F.round(F.avg(value), 9).alias("m"))
    one = first_by(g, ["dataset"], F.col("b").asc(), F.col("detector").asc()).select("dataset", F.col("detector").alias("borda_pick"))
    return one.join(first_by(g, ["dataset"], F.col("m").desc(), F.col("detector").asc()).select("dataset", F.col("detector").alias("mean_pick")), "dataset")


def combine_probes(grades: DataFrame, value: str = "pseudo") -> DataFrame:
    """(dataset, rule, detector): borda, worst-case rank, rank product, spread-weighted rank, and routing to the probe with
    the largest spread or margin."""
    w = W.partitionBy("dataset", "subset")
    r = grades.withColumn("_r", average_rank(["dataset", "subset"], value, True)).withColumn("_d", F.coalesce(F.stddev_pop(value).over(w), F.lit(0.0)))
    first = w.orderBy(F.col(value).desc(), "detector")
    r = r.withColumn("_k", F.row_number().over(first)).withColumn("_g", F.when(F.col("_k") == 1, F.col(value) - F.coalesce(F.lead(value).over(first), F.col(value))))
    g = r.groupBy("dataset", "detector").agg(F.round(F.sum("_r"), 9).alias("borda"), F.max("_r").alias("worst"), F.round(F.sum(F.ln("_r")), 9).alias("product"), F.round(F.sum(F.col("_r") * F.col("_d")), 9).alias("discriminative"))
    ranked = [first_by(g, ["dataset"], F.col(c).asc(), F.col("detector").asc()).select("dataset", F.lit(c).alias("rule"), "detector") for c in ("borda", "worst", "product", "discriminative")]
    tops = r.where("_k = 1")
    routed = [first_by(tops, ["dataset"], F.round(c, 9).desc(), F.col("subset").asc()).select("dataset", F.lit(n).alias("rule"), "detector") for n, c in (("confidence", "_d"), ("margin", "_g"))]
    out = ranked[0]
    for more in ranked[1:] + routed:
        out = out.unionAll(more)
    return out


def label_selection(outranked: DataFrame, default: str, least_gain: float = 0.05) -> DataFrame:
    """(dataset, detector): the largest mean share of normals outranked, the default unless the gain is large enough."""
    g = outranked.withColumn("_d", F.max(F.when(F.col("detector") == default, F.col("share"))).over(W.partitionBy("dataset")))
    best = first_by(g, ["dataset"], F.col("share").desc(), (F.col("detector") == default).desc(), F.col("detector").asc())
    return best.select("dataset", F.when(F.col("_d").isNotNull() & (F.col("share") - F.col("_d") < least_gain), F.lit(default)).otherwise(F.col("detector")).alias("detector"))


def share_below(scores: DataFrame, calibration: DataFrame, by: list[str]) -> DataFrame:
    """(by, row_id, share): the share of calibration scores below each score, ties a half: an as-of lookup.

    Calibration values become running counts and scores join the union's order: no pair of scores is formed.
    """
    c = calibration.groupBy(*by, F.col("score").alias("v")).agg(F.count(F.lit(1)).alias("c")).select(*by, "v", "c", F.lit(None).cast("bigint").alias("row_id"))
    s = scores.select(*by, F.col("score").alias("v"), F.lit(0).cast("bigint").alias("c"), "row_id")
    w = W.partitionBy(*by)
    upto = F.sum("c").over(w.orderBy("v").rangeBetween(W.unboundedPreceding, 0))
    here = F.sum("c").over(W.partitionBy(*by, "v"))
    u = c.unionAll(s).withColumn("share", (upto - here / 2.0) / F.sum("c").over(w))
    return u.where("row_id IS NOT NULL").select(*by, "row_id", "share")


def hedge(a: DataFrame, b: DataFrame) -> DataFrame:
    """(dataset, row_id, score): mean of two calibrated shares."""
    return a.select("dataset", "row_id", F.col("share").alias("_a")).join(b.select("dataset", "row_id", F.col("share").alias("_b")), ["dataset", "row_id"]).select("dataset", "row_id", ((F.col("_a") + F.col("_b")) / 2).alias("score"))


def portfolio(scores: DataFrame, calibration: DataFrame) -> DataFrame:
    """(dataset, row_id, largest, mean) of -ln (1 + number of calibration scores at or above) / (n + 1) over detectors."""
    by = ["dataset", "detector"]
    c = calibration.groupBy(*by, F.col("score").alias("v")).agg(F.count(F.lit(1)).alias("c")).select(*by, "v", "c", F.lit(None).cast("bigint").alias("row_id"))
    s = scores.select(*by, F.col("score").alias("v"), F.lit(0).cast("bigint").alias("c"), "row_id")
    w = W.partitionBy(*by)
    over = F.sum("c").over(w.orderBy(F.col("v").desc()).rangeBetween(W.unboundedPreceding, 0))
    u = c.unionAll(s).withColumn("t", -F.ln((1 + over) / (F.sum("c").over(w) + 1.0))).where("row_id IS NOT NULL")
    return u.groupBy("dataset", "row_id").agg(F.max("t").alias("largest"), F.avg("t").alias("mean"))


def acquisition(scores: DataFrame, mode: str, n: int, seed: object) -> DataFrame:
    """(dataset, row_id): what an analyst labels: n rows at random (iid), the n highest (caught) or n of the lower half (missed)."""
    from siftlake.functions.ranks import draw_order

    w = W.partitionBy("dataset")
    if mode == "caught":
        order = w.orderBy(F.col("score").desc(), "row_id")
        return scores.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).select("dataset", "row_id")
    s = scores if mode == "iid" else scores.withColumn("_m", F.percentile("score", 0.5).over(w)).where("score < _m")
    return s.withColumn("_k", F.row_number().over(w.orderBy(draw_order(seed, "row_id")))).where(F.col("_k") <= n).select("dataset", "row_id")
