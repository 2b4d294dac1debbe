"""Queries of the metrics, aggregations and rank statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions.ranks import average_rank, first_by, min_max
from siftlake.operators import detectors as D
from siftlake.operators import metrics as M
from siftlake.operators import pseudo as G
from siftlake.plans import base
from siftlake.plans.base import FEATURES, sql
from siftlake.plans.registry import query
from siftlake.session import stored

BY = ["dataset", "detector"]

_CUM = "SELECT dataset, detector, score, pos, neg, sum(pos) OVER r AS cp, sum(neg) OVER r AS cn, sum(pos) OVER g AS ap, sum(neg) OVER g AS an FROM (SELECT dataset, detector, score, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY ALL) WINDOW r AS (PARTITION BY dataset, detector ORDER BY score DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY dataset, detector)"
CUM = _CUM.format(src="point")


@query(sql("point", f"WITH c AS ({CUM}), a AS (SELECT dataset, detector, sum(pos * (an - cn + neg / 2.0)) / (max(ap)::DOUBLE * max(an)) AS auc, sum(pos * cp / (cp + cn)) / max(ap) AS ap, max(ap) / (max(ap) + max(an)) AS br FROM c GROUP BY ALL), f AS (SELECT *, (ap - br) / (1 - br) AS q FROM a) SELECT dataset, detector, round(auc, 6) AS auc, round(ap, 6) AS ap, round(q, 6) AS ap_norm, row_number() OVER (PARTITION BY dataset ORDER BY round(auc, 6) DESC, detector) AS place, round(max(q) OVER (PARTITION BY dataset) - q, 6) AS regret FROM f"))
def flagship_detector_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank four marginal detectors for each data set by AUC, with normalised AP and its regret."""
    p = base.point(spark, sf_dir)
    a = M.roc_auc(p, BY).join(M.average_precision(p, BY), BY).withColumn("q", M.normalised(F.col("ap"), F.col("base_rate")))
    w = W.partitionBy("dataset")
    return a.select(*BY, F.round("auc", 6).alias("auc"), F.round("ap", 6).alias("ap"), F.round("q", 6).alias("ap_norm"), F.row_number().over(w.orderBy(F.round("auc", 6).desc(), "detector")).alias("place"), F.round(F.max("q").over(w) - F.col("q"), 6).alias("regret"))


@query(sql("point", "SELECT a.dataset, a.detector, round(a.auc, 6) AS auc FROM (WITH r AS (SELECT dataset, detector, y, rank() OVER (PARTITION BY dataset, detector ORDER BY score) + (count(*) OVER (PARTITION BY dataset, detector, score) - 1) / 2.0 AS k FROM point) SELECT dataset, detector, (sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * sum(1 - y)) AS auc FROM r GROUP BY ALL) a"))
def m1_roc_auc(spark, sf_dir):
    return M.roc_auc(base.point(spark, sf_dir), BY, splits=8).select(*BY, F.round("auc", 6).alias("auc"))


@query(sql("point", f"WITH c AS ({CUM}) SELECT dataset, detector, round(sum(pos * cp / (cp + cn)) / max(ap), 6) AS ap, round(max(ap) / (max(ap) + max(an)), 6) AS base_rate FROM c GROUP BY ALL"))
def m2_average_precision(spark, sf_dir):
    return M.average_precision(base.point(spark, sf_dir), BY).select(*BY, F.round("ap", 6).alias("ap"), F.round("base_rate", 6).alias("base_rate"))


@query(sql("point", f"WITH c AS ({CUM}), a AS (SELECT dataset, detector, sum(pos * cp / (cp + cn)) / max(ap) AS ap, max(ap) / (max(ap) + max(an)) AS br FROM c GROUP BY ALL) SELECT dataset, detector, round((ap - br) / (1 - br), 6) AS ap_norm, round((ap - br) / (1 - br + 1e-12), 6) AS ap_norm_eps, round(ap / br, 6) AS lift FROM a"))
def m3_m7_normalised_ap_and_lift(spark, sf_dir):
    a = M.average_precision(base.point(spark, sf_dir), BY)
    ap, r = F.col("ap"), F.col("base_rate")
    return a.select(*BY, F.round(M.normalised(ap, r), 6).alias("ap_norm"), F.round(M.normalised(ap, r, 1e-12), 6).alias("ap_norm_eps"), F.round(F.try_divide(ap, r), 6).alias("lift"))


def _pauc_sql(limit: float, name: str) -> str:
    least = limit * limit / 2
    return f"(SELECT dataset, detector, round(0.5 * (1 + (sum((least(x1, {limit}) - x0) * (t0 + CASE WHEN x1 > x0 THEN t0 + (t1 - t0) * (least(x1, {limit}) - x0) / (x1 - x0) ELSE t1 END) / 2.0) - {least}) / ({limit} - {least})), 6) AS {name} FROM e WHERE x0 < {limit} GROUP BY ALL)"


@query(sql("point", f"WITH c AS ({CUM}), e AS (SELECT dataset, detector, (cn - neg) / an AS x0, cn / an AS x1, (cp - pos) / ap AS t0, cp / ap AS t1 FROM c) SELECT * FROM {_pauc_sql(0.1, 'pauc_10')} JOIN {_pauc_sql(0.01, 'pauc_01')} USING (dataset, detector)"))
def m4_partial_auc(spark, sf_dir):
    p = base.point(spark, sf_dir)
    a, b = (M.partial_auc(p, BY, limit).select(*BY, F.round("pauc", 6).alias(name)) for limit, name in ((0.1, "pauc_10"), (0.01, "pauc_01")))
    return a.join(b, BY)


@query(sql("point", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY dataset, detector ORDER BY score DESC, row_id) AS k, sum(y) OVER (PARTITION BY dataset, detector) AS p, count(*) OVER (PARTITION BY dataset, detector) AS n FROM point) SELECT dataset, detector, round(avg(y), 6) AS p_at_n, round(avg(y) / max(p / n), 6) AS lift_at_n FROM r WHERE k <= p GROUP BY ALL"))
def m5_precision_at_n(spark, sf_dir):
    return M.precision_at_n(base.point(spark, sf_dir), BY, "row_id").select(*BY, F.round("p_at_n", 6).alias("p_at_n"), F.round("lift_at_n", 6).alias("lift_at_n"))


@query(sql("point", "WITH q AS (SELECT dataset, detector, quantile_cont(score, 0.99) AS q1, quantile_cont(score, 0.95) AS q5 FROM point WHERE y = 0 AND row_id % 2 = 0 GROUP BY ALL) SELECT dataset, detector, round(avg(CASE WHEN score > q1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN score > q5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5 FROM point JOIN q USING (dataset, detector) WHERE y = 1 GROUP BY ALL"))
def m6_recall_at_fpr(spark, sf_dir):
    p = base.point(spark, sf_dir)
    return M.recall_at_rates(p, p.where("y = 0 AND row_id % 2 = 0"), BY).select(*BY, F.round("recall_1", 6).alias("recall_1"), F.round("recall_5", 6).alias("recall_5"))


_ROC = """WITH c AS (SELECT dataset, detector, score, sum(y) AS p, sum(1 - y) AS n FROM point GROUP BY ALL),
r AS (SELECT dataset, detector, {'x': sum(n) OVER w / sum(n) OVER a, 'y': sum(p) OVER w / sum(p) OVER a} AS p FROM c WINDOW w AS (PARTITION BY dataset, detector ORDER BY score DESC), a AS (PARTITION BY dataset, detector)),
e AS (SELECT dataset, detector, coalesce(max(p) FILTER (p.x <= 0.1), {'x': 0.0, 'y': 0.0}) AS a, min(p) FILTER (p.x > 0.1) AS z FROM r GROUP BY ALL)
SELECT dataset, detector, round(coalesce(a.y + (0.1 - a.x) * (z.y - a.y) / (z.x - a.x), a.y), 6) AS recall FROM e"""


@query(sql("point", _ROC))
def m6_interpolated_recall(spark, sf_dir):
    return M.recall_at_rate(base.point(spark, sf_dir), BY, splits=8).select(*BY, F.round("recall", 6).alias("recall"))


@query()
def m8_m9_m10_excess_mass_and_mass_volume(spark, sf_dir):
    """EM and MV of z-score detectors against a uniform box of hash draws (M11)."""
    return M.mass_criteria(_boxed(spark, sf_dir), BY)


def _boxed(spark, sf_dir):
    from siftlake.operators.synth import uniform_box

    t = base.tab(spark, sf_dir)
    moments = base.long(t).groupBy("dataset", "feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    box = uniform_box(t, base.FEATURES, 8000, seed=11)
    rows = base.long(t).select("dataset", "feature", "value", F.lit(False).alias("uniform")).unionByName(base.long(box.withColumn("y", F.lit(0))).select("dataset", "feature", "value", F.lit(True).alias("uniform")))
    z = F.abs((F.col("value") - F.col("m")) / (F.col("s") + 1e-9))
    return rows.join(moments, ["dataset", "feature"]).select("dataset", F.col("feature").alias("detector"), z.alias("score"), "uniform")


@query(sql("tab", "WITH b AS (SELECT dataset, min(x1) AS l1, max(x1) - min(x1) AS s1, min(x2) AS l2, max(x2) - min(x2) AS s2 FROM tab GROUP BY ALL) SELECT dataset, i AS row_id, round(l1 + ('0x' || substr(md5('11:x1:' || i), 1, 8))::BIGINT / 4294967296.0 * CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 5) AS x1, round(l2 + ('0x' || substr(md5('11:x2:' || i), 1, 8))::BIGINT / 4294967296.0 * CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 5) AS x2 FROM b, range(200) t(i)"))
def m11_uniform_box(spark, sf_dir):
    from siftlake.operators.synth import uniform_box

    return uniform_box(base.tab(spark, sf_dir), ("x1", "x2"), 200, seed=11).select("dataset", "row_id", F.round("x1", 5).alias("x1"), F.round("x2", 5).alias("x2"))


_RANKED = "SELECT *, rank() OVER (PARTITION BY dataset, detector ORDER BY score) + (count(*) OVER (PARTITION BY dataset, detector, score) - 1) / 2.0 AS r FROM point"


@query(sql("point", f"WITH r AS ({_RANKED}), m AS (SELECT dataset, row_id, avg(r) AS m FROM r GROUP BY ALL), c AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY m) + (count(*) OVER (PARTITION BY dataset, m) - 1) / 2.0 AS c FROM m) SELECT dataset, detector AS key, round(corr(r, c), 6) AS udr FROM r JOIN c USING (dataset, row_id) GROUP BY ALL"))
def m12_udr_consensus(spark, sf_dir):
    return M.udr(base.point(spark, sf_dir), ["dataset"], "detector", "row_id", "score").select("dataset", "key", F.round("udr", 6).alias("udr"))


@query(sql("point", f"WITH r AS ({_RANKED}), p AS (SELECT a.dataset, a.detector AS a, b.detector AS b, corr(a.r, b.r) AS rho FROM r a JOIN r b ON a.dataset = b.dataset AND a.row_id = b.row_id AND a.detector <> b.detector GROUP BY ALL) SELECT dataset, a AS key, round(avg(rho), 6) AS centrality FROM p GROUP BY ALL"))
def m13_model_centrality(spark, sf_dir):
    pairs = M.pairwise_spearman(base.point(spark, sf_dir), ["dataset"], "detector", "row_id", "score")
    return M.centrality(pairs, ["dataset"]).select("dataset", "key", F.round("centrality", 6).alias("centrality"))


@query()
def m14_hits_authority(spark, sf_dir):
    return M.hits(M.pairwise_spearman(base.point(spark, sf_dir), ["dataset"], "detector", "row_id", "score"), ["dataset"])


@query(sql("point", f"WITH r AS ({_RANKED}), p AS (SELECT a.dataset, corr(a.r, b.r) AS rho FROM r a JOIN r b ON a.dataset = b.dataset AND a.row_id = b.row_id AND a.detector < b.detector GROUP BY a.dataset, a.detector, b.detector) SELECT dataset, round(quantile_cont(rho, 0.5), 6) AS agreement FROM p GROUP BY ALL"))
def m15_seed_agreement(spark, sf_dir):
    pairs = M.pairwise_spearman(base.point(spark, sf_dir), ["dataset"], "detector", "row_id", "score")
    return M.seed_agreement(pairs, ["dataset"]).select("dataset", F.round("agreement", 6).alias("agreement"))


FORESTS = {f"{n}_{share}": (n, share) for n in (50, 100, 200) for share in (0.5, 0.75, 1.0)}


@query()
def m15_forest_stability(spark, sf_dir):
    """Nine forest configurations with three seeds each, fitted on 80 % of the normals: the agreement of a configuration's seeds on
    the other rows, its mean normalised precision, and whether it is the most stable."""
    rows = stored(base.tab(spark, sf_dir), "rows")
    roles = stored(G.true_roles(rows, 3), "roles")
    own = lambda c: rows.join(roles.where(c).select("dataset", "row_id"), ["dataset", "row_id"])
    s = stored(D.forest_bank(own("role <> 'train'"), FEATURES, FORESTS, (0, 1, 2), train=own("role = 'train'")), "scores")
    by = ["dataset", "configuration"]
    agreement = M.seed_agreement(M.pairwise_spearman(s, by, "seed", "row_id", "score"), by)
    graded = M.average_precision(s.join(rows.select("dataset", "row_id", "y"), ["dataset", "row_id"]), [*by, "seed"])
    base_rate = roles.where("role <> 'train'").groupBy("dataset").agg(F.avg((F.col("role") == "anom").cast("double")).alias("base"))
    graded = graded.join(base_rate, "dataset").groupBy(*by).agg(F.avg((F.col("ap") - F.col("base")) / (1 - F.col("base") + 1e-12)).alias("ap_norm"))
    best = W.partitionBy("dataset").orderBy(F.col("agreement").desc(), "configuration")
    return agreement.join(graded, by).withColumn("picked", F.row_number().over(best) == 1)


@query(sql("grade", "WITH r AS (SELECT dataset, rank() OVER (PARTITION BY dataset ORDER BY pseudo) + (count(*) OVER (PARTITION BY dataset, pseudo) - 1) / 2.0 AS a, rank() OVER (PARTITION BY dataset ORDER BY truth) + (count(*) OVER (PARTITION BY dataset, truth) - 1) / 2.0 AS b FROM grade), s AS (SELECT dataset, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY ALL), k AS (SELECT x.dataset, round(sum(sign(x.pseudo - z.pseudo) * sign(x.truth - z.truth)) / sqrt(sum(abs(sign(x.pseudo - z.pseudo)))::DOUBLE * sum(abs(sign(x.truth - z.truth)))), 6) AS tau FROM grade x JOIN grade z ON x.dataset = z.dataset AND x.detector < z.detector GROUP BY ALL) SELECT * FROM s JOIN k USING (dataset)"))
def m17_spearman_and_kendall(spark, sf_dir):
    g = base.grade(spark, sf_dir)
    s = M.spearman(g, ["dataset"], "pseudo", "truth").select("dataset", F.round("rho", 6).alias("rho"), "n")
    return s.join(M.kendall(g, ["dataset"], "detector", "pseudo", "truth").select("dataset", F.round("tau", 6).alias("tau")), "dataset")


@query(sql("grade", "WITH r AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY truth DESC, detector) AS t, row_number() OVER (PARTITION BY dataset ORDER BY pseudo DESC, detector) AS g FROM grade) SELECT dataset, max(CASE WHEN t = 1 AND g = 1 THEN 1 ELSE 0 END) AS top1_hit, round(sum(CASE WHEN t <= 3 AND g <= 3 THEN 1 ELSE 0 END) / 3.0, 6) AS top3_hit_ratio FROM r GROUP BY ALL"))
def m18_top_hits(spark, sf_dir):
    return M.top_hits(base.grade(spark, sf_dir), ["dataset"], "detector", "truth", "pseudo").withColumn("top3_hit_ratio", F.round("top3_hit_ratio", 6))


@query(sql("grade", "WITH g AS (SELECT dataset, CASE WHEN dataset LIKE '%1' THEN 0.5 ELSE truth END AS t, CASE WHEN dataset LIKE '%2' THEN 0.5 ELSE pseudo END AS p FROM grade WHERE NOT (dataset LIKE '%3' AND detector > 'k2')) SELECT dataset, CASE WHEN count(*) < 3 THEN 'n<3' WHEN max(t) - min(t) < 1e-6 THEN 'true_all_tied' WHEN max(p) - min(p) < 1e-6 THEN 'pred_all_tied' ELSE '' END AS note FROM g GROUP BY ALL"))
def m19_rank_guard(spark, sf_dir):
    g = base.grade(spark, sf_dir).where("NOT (dataset LIKE '%3' AND detector > 'k2')")
    g = g.withColumn("truth", F.expr("CASE WHEN dataset LIKE '%1' THEN 0.5D ELSE truth END")).withColumn("pseudo", F.expr("CASE WHEN dataset LIKE '%2' THEN 0.5D ELSE pseudo END"))
    return M.rank_guard(g, ["dataset"], "truth", "pseudo")


_REGRET = "SELECT dataset, modality, corpus, max(truth) - max(CASE WHEN g = 1 THEN truth END) AS regret1, max(truth) - max(CASE WHEN g <= 3 THEN truth END) AS regret3, max(truth) - avg(truth) AS random_regret, max(truth) - min(truth) AS worst_regret, max(CASE WHEN g = 1 THEN CASE WHEN n > 1 THEN (t - 1) / (n - 1) ELSE 0.0 END END) AS norm_rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pseudo DESC, detector) AS g, rank() OVER (PARTITION BY dataset ORDER BY truth DESC) + (count(*) OVER (PARTITION BY dataset, truth) - 1) / 2.0 AS t, count(*) OVER (PARTITION BY dataset) AS n FROM grade) GROUP BY ALL"


def _regrets(spark, sf_dir):
    return M.regret(base.grade(spark, sf_dir), ["dataset", "modality", "corpus"], "detector", "truth", "pseudo")


@query(sql("grade", f"SELECT dataset, modality, corpus, round(regret1, 11) AS regret1, round(regret3, 11) AS regret3, round(random_regret, 11) AS random_regret, round(worst_regret, 11) AS worst_regret, round(norm_rank, 11) AS norm_rank FROM ({_REGRET})"))
def m20_regret(spark, sf_dir):
    return _regrets(spark, sf_dir).select("dataset", "modality", "corpus", *[F.round(c, 11).alias(c) for c in ("regret1", "regret3", "random_regret", "worst_regret", "norm_rank")])


@query(sql("grade", f"WITH r AS ({_REGRET}) SELECT 'macro' AS kind, round(avg(m), 11) AS regret1 FROM (SELECT avg(regret1) AS m FROM r GROUP BY modality) UNION ALL SELECT 'balanced', round(avg(m), 11) FROM (SELECT avg(regret1) AS m FROM r GROUP BY corpus)"))
def m21_m22_macro_and_balanced_regret(spark, sf_dir):
    r = _regrets(spark, sf_dir)
    one, two = (M.nested_mean(r, [], [by], "regret1").select(F.lit(kind).alias("kind"), F.round("regret1", 11).alias("regret1")) for kind, by in (("macro", "modality"), ("balanced", "corpus")))
    return one.unionAll(two)


@query(sql("grade", f"SELECT modality, round(avg(regret1), 11) AS mean_regret, round(quantile_cont(regret1, 0.5), 11) AS median_regret, round(quantile_cont(regret1, 0.9), 11) AS p90_regret, round(max(regret1), 11) AS worst_regret, round(avg(CASE WHEN regret1 < 0.01 THEN 1.0 ELSE 0.0 END), 11) AS share_optimal, round(avg(CASE WHEN regret1 > 0.3 THEN 1.0 ELSE 0.0 END), 11) AS share_bad FROM ({_REGRET}) GROUP BY ALL"))
def m23_regret_distribution(spark, sf_dir):
    d = M.regret_shape(_regrets(spark, sf_dir), ["modality"], "regret1")
    return d.select("modality", *[F.round(c, 11).alias(c) for c in d.columns[1:]])


@query(sql("fact", "SELECT modality, corpus, round(avg(truth), 11) AS mean_truth, round(quantile_cont(truth, 0.5), 11) AS median_truth, round(stddev_samp(truth), 11) AS std_truth, round(var_samp(truth), 11) AS var_truth, min(truth) AS min_truth, max(truth) AS max_truth, count(*) AS n, count(DISTINCT dataset) AS n_datasets, count(CASE WHEN pseudo > 0.5 THEN 1 END) AS n_high, min(dataset) AS first_dataset FROM fact GROUP BY ALL"))
def a1_a2_grouped_summaries(spark, sf_dir):
    f = base.fact(spark, sf_dir)
    r = lambda c, name: F.round(c, 11).alias(name)
    return f.groupBy("modality", "corpus").agg(r(F.avg("truth"), "mean_truth"), r(F.percentile("truth", 0.5), "median_truth"), r(F.stddev_samp("truth"), "std_truth"), r(F.var_samp("truth"), "var_truth"), F.min("truth").alias("min_truth"), F.max("truth").alias("max_truth"), F.count(F.lit(1)).alias("n"), F.countDistinct("dataset").alias("n_datasets"), F.count(F.expr("CASE WHEN pseudo > 0.5 THEN 1 END")).alias("n_high"), F.min("dataset").alias("first_dataset"))


@query(sql("grade", "SELECT dataset, round(max(truth) - min(truth), 11) AS true_spread, round(max(truth) - avg(truth), 11) AS spread_ap_norm FROM grade GROUP BY ALL"))
def a3_two_spreads(spark, sf_dir):
    return base.grade(spark, sf_dir).groupBy("dataset").agg(F.round(F.max("truth") - F.min("truth"), 11).alias("true_spread"), F.round(F.max("truth") - F.avg("truth"), 11).alias("spread_ap_norm"))


@query(sql("fact", "WITH v AS (SELECT dataset, subset, coalesce(var_samp(pseudo), 0) AS w FROM fact GROUP BY ALL) SELECT dataset, detector, round(CASE WHEN sum(w) < 1e-12 THEN avg(pseudo) ELSE sum(pseudo * w) / sum(w) END, 11) AS wmean FROM fact JOIN v USING (dataset, subset) GROUP BY ALL"))
def a4_weighted_mean(spark, sf_dir):
    from pyspark.sql import Window as W

    weight = F.var_samp("pseudo").over(W.partitionBy("dataset", "subset"))
    f = base.fact(spark, sf_dir).withColumn("w", weight)
    return M.weighted_mean(f, BY, "pseudo", F.col("w")).withColumn("wmean", F.round("wmean", 11))


@query(sql("fact", "SELECT corpus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 11) AS share FROM fact GROUP BY corpus"))
def a5_value_counts(spark, sf_dir):
    from pyspark.sql import Window as W

    c = base.fact(spark, sf_dir).groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 11))


@query(sql("fact", "SELECT corpus, " + ", ".join(f"round(avg(CASE WHEN detector = 'k{i}' THEN truth END), 11) AS k{i}" for i in range(1, 8)) + " FROM fact GROUP BY ALL"))
def a6_pivot(spark, sf_dir):
    kinds = [f"k{i}" for i in range(1, 8)]
    p = base.fact(spark, sf_dir).groupBy("corpus").pivot("detector", kinds).agg(F.avg("truth"))
    return p.select("corpus", *[F.round(k, 11).alias(k) for k in kinds])


@query(sql("grade", "SELECT dataset, detector, round(truth - quantile_cont(truth, 0.5) OVER (PARTITION BY dataset), 11) AS above_median FROM grade"))
def a7_group_transform(spark, sf_dir):
    from pyspark.sql import Window as W

    return base.grade(spark, sf_dir).select(*BY, F.round(F.col("truth") - F.percentile("truth", 0.5).over(W.partitionBy("dataset")), 11).alias("above_median"))


@query(sql("fact", "SELECT modality, " + ", ".join(f"round(quantile_cont(truth, {q / 100}), 11) AS q{q}" for q in (0, 25, 50, 75, 100)) + " FROM fact GROUP BY ALL"))
def a8_quantile_summary(spark, sf_dir):
    qs = (0, 25, 50, 75, 100)
    p = base.fact(spark, sf_dir).groupBy("modality").agg(F.percentile("truth", F.array(*[F.lit(q / 100) for q in qs])).alias("p"))
    return p.select("modality", *[F.round(F.col("p")[i], 11).alias(f"q{q}") for i, q in enumerate(qs)])


_WILSON = "round((p + 1.9208 / n {s} 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 11)"


@query(sql("grade", f"WITH e AS (SELECT {', '.join(f'quantile_cont(pseudo, {k / 5}) AS e{k}' for k in range(1, 5))} FROM grade), b AS (SELECT (pseudo > e1)::INT + (pseudo > e2)::INT + (pseudo > e3)::INT + (pseudo > e4)::INT AS bin, CASE WHEN truth > 0.5 THEN 1.0 ELSE 0.0 END AS hit FROM grade, e), g AS (SELECT bin, count(*) AS n, avg(hit) AS p FROM b GROUP BY ALL) SELECT bin, n, round(p, 11) AS share, {_WILSON.format(s='-')} AS low, {_WILSON.format(s='+')} AS high FROM g"))
def a9_quintiles_with_wilson_interval(spark, sf_dir):
    g = base.grade(spark, sf_dir)
    edges = g.agg(F.percentile("pseudo", F.array(*[F.lit(k / 5) for k in range(1, 5)])).alias("e"))  # one row
    b = g.crossJoin(F.broadcast(edges)).select(F.expr("size(filter(e, x -> pseudo > x))").alias("bin"), F.expr("CASE WHEN truth > 0.5 THEN 1.0D ELSE 0.0D END").alias("hit"))
    c = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("p"))
    return c.select("bin", "n", F.round("p", 11).alias("share"), F.expr(_WILSON.format(s="-")).alias("low"), F.expr(_WILSON.format(s="+")).alias("high"))
