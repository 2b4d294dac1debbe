"""Queries of selection rules, tests, pseudo-label evaluation, synthetic rows and descriptions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.operators import describe as X
from siftlake.operators import detectors as D
from siftlake.operators import metrics as M
from siftlake.operators import mixtures as MX
from siftlake.operators import modality as MO
from siftlake.operators import networks as N
from siftlake.operators import pseudo as G
from siftlake.operators import select as R
from siftlake.operators import space as E
from siftlake.operators import stats as T
from siftlake.operators import synth as Y
from siftlake.plans import base
from siftlake.plans.base import FEATURES, sql
from siftlake.plans.detector_queries import _GRID, _grid
from siftlake.plans.metric_queries import _REGRET, _regrets
from siftlake.plans.registry import query
from siftlake.session import stored

AVG = lambda by, c, d="": f"rank() OVER (PARTITION BY {by} ORDER BY {c}{d}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"


def _pick(order: str, src: str = "grade", where: str = "true") -> str:
    return f"SELECT dataset, detector FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {order}, detector) AS k FROM {src} WHERE {where}) WHERE k = 1"


# --- selection

_AGG = f"r AS (SELECT *, {AVG('dataset, subset', 'pseudo', ' DESC')} AS r, coalesce(var_samp(pseudo) OVER (PARTITION BY dataset, subset), 0) AS w FROM fact), g AS (SELECT dataset, detector, round(avg(pseudo), 9) AS mean, round(-avg(r), 9) AS borda, round(CASE WHEN sum(w) < 1e-12 THEN avg(pseudo) ELSE sum(w * pseudo) / sum(w) END, 9) AS varweight FROM r GROUP BY ALL), l AS (UNPIVOT g ON mean, borda, varweight INTO NAME aggregation VALUE score)"


@query(sql("fact", f"WITH {_AGG} SELECT dataset, detector, aggregation, score, {AVG('dataset, aggregation', 'score', ' DESC')} AS rank FROM l"))
def r1_rank_aggregation(spark, sf_dir):
    return R.aggregate_ranks(base.fact(spark, sf_dir))


def _regime_scores(spark, sf_dir):
    """(dataset, regime, subset, detector, pseudo): return flags play the regimes, each with its two halves of suppliers' lines."""
    li = base.table(spark, sf_dir, "lineitem").withColumn("half", F.col("l_orderkey") % 2)
    g = li.groupBy("l_suppkey", "l_returnflag", "half", "l_linenumber").agg(F.round(F.avg("l_discount") * 10, 6).alias("pseudo"))
    return g.select(F.expr("concat('s', l_suppkey)").alias("dataset"), F.col("l_returnflag").alias("regime"), F.col("half").cast("string").alias("subset"), F.expr("concat('k', l_linenumber)").alias("detector"), "pseudo")


_REG = "q AS (SELECT 's' || l_suppkey AS dataset, l_returnflag AS regime, l_orderkey % 2 AS subset, 'k' || l_linenumber AS detector, round(avg(l_discount) * 10, 6) AS pseudo FROM lineitem GROUP BY ALL)"
_WEIGHTS = f"{_REG}, rr AS (SELECT *, {AVG('dataset, regime, subset', 'pseudo', ' DESC')} AS r FROM q), d AS (SELECT dataset, regime, detector, avg(pseudo) AS m, stddev_pop(r) AS s FROM rr GROUP BY ALL), dd AS (SELECT *, lead(m) OVER o AS nx, row_number() OVER o AS k FROM d WINDOW o AS (PARTITION BY dataset, regime ORDER BY m DESC, detector)), w AS (SELECT dataset, regime, coalesce(var_samp(m), 0) AS variance, 1 / (avg(s) + 1e-6) AS stability, max(CASE WHEN k = 1 THEN m - nx END) AS margin FROM dd GROUP BY ALL)"


@query(f"WITH {_WEIGHTS} SELECT dataset, regime, round(variance, 8) AS variance, round(stability, 6) AS stability, round(margin, 8) AS margin, round(exp((variance - max(variance) OVER p) / 0.01) / sum(exp((variance - vm) / 0.01)) OVER p, 6) AS softmax FROM (SELECT *, max(variance) OVER (PARTITION BY dataset) AS vm FROM w) WINDOW p AS (PARTITION BY dataset)")
def r2_regime_weights(spark, sf_dir):
    w = R.regime_weights(_regime_scores(spark, sf_dir))
    return w.select("dataset", "regime", F.round("variance", 8).alias("variance"), F.round("stability", 6).alias("stability"), F.round("margin", 8).alias("margin"), F.round("softmax", 6).alias("softmax"))


_MEANS = f"{_REG}, s AS (SELECT dataset, regime, detector, round(avg(pseudo), 9) AS score FROM q GROUP BY ALL)"


def _means(spark, sf_dir):
    return _regime_scores(spark, sf_dir).groupBy("dataset", "regime", "detector").agg(F.round(F.avg("pseudo"), 9).alias("score"))


@query(f"WITH {_MEANS}, r AS (SELECT *, {AVG('dataset, regime', 'score')} AS r FROM s) SELECT dataset, regime, round(greatest(avg(rho), 0), 6) AS agreement FROM (SELECT a.dataset, a.regime, corr(a.r, b.r) AS rho FROM r a JOIN r b ON a.dataset = b.dataset AND a.detector = b.detector AND a.regime <> b.regime GROUP BY a.dataset, a.regime, b.regime) GROUP BY ALL")
def r2_agreement_weights(spark, sf_dir):
    return R.agreement_weights(_means(spark, sf_dir)).withColumn("agreement", F.round("agreement", 6))


def _combined(expr: str) -> str:
    return f"WITH {_MEANS}, w AS (SELECT dataset, regime, 1.0 AS w FROM s GROUP BY ALL), r AS (SELECT s.*, w, {AVG('s.dataset, s.regime', 'score', ' DESC')} AS r, row_number() OVER (PARTITION BY s.dataset, s.regime ORDER BY score DESC, detector) AS k, count(*) OVER (PARTITION BY s.dataset, s.regime) AS n, coalesce((score - avg(score) OVER (PARTITION BY s.dataset, s.regime)) / nullif(stddev_pop(score) OVER (PARTITION BY s.dataset, s.regime), 0), 0) AS z FROM s JOIN w USING (dataset, regime)) SELECT dataset, detector, round({expr}, 6) AS score FROM r GROUP BY ALL"


def _combine(spark, sf_dir, how):
    s = _means(spark, sf_dir)
    w = s.select("dataset", "regime", F.lit(1.0).alias("one")).distinct()
    return R.combine(s, w, "one", how).withColumn("score", F.round("score", 6))


@query(_combined("sum(w * -r) / sum(w)"))
def r3_weighted_rank_average(spark, sf_dir):
    return _combine(spark, sf_dir, "rank")


@query(_combined("sum(w * z) / sum(w)"))
def r3_weighted_z_average(spark, sf_dir):
    return _combine(spark, sf_dir, "z")


@query(_combined("sum(CASE WHEN k = 1 THEN w * 1000 ELSE 0 END + n - r)"))
def r3_top_vote(spark, sf_dir):
    return _combine(spark, sf_dir, "vote")


@query(f"WITH {_WEIGHTS} SELECT dataset, regime FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(variance, 9) DESC, regime) AS k FROM w) WHERE k = 1")
def r4_best_regime(spark, sf_dir):
    from siftlake.functions.ranks import first_by

    return first_by(R.regime_weights(_regime_scores(spark, sf_dir)), ["dataset"], F.round("variance", 9).desc(), F.col("regime").asc()).select("dataset", "regime")


@query(sql("grade", "WITH z AS (SELECT dataset, detector, pseudo AS s, coalesce((pseudo - avg(pseudo) OVER d) / nullif(stddev_pop(pseudo) OVER d, 0), 0) AS z FROM grade WINDOW d AS (PARTITION BY detector)) SELECT dataset, detector, round(0.5 * (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) + 0.5 * (z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w), 6) AS score FROM z WINDOW w AS (PARTITION BY dataset)"))
def r5_debias(spark, sf_dir):
    return R.debias(base.grade(spark, sf_dir), 0.5, "pseudo").withColumn("score", F.round("score", 6))


@query(f"WITH {_MEANS}, t AS (SELECT *, lead(score) OVER o AS nx, row_number() OVER o AS k FROM s WINDOW o AS (PARTITION BY dataset, regime ORDER BY score DESC, detector)), v AS (SELECT dataset, detector, count(*) AS v, sum(score - nx) AS m FROM t WHERE k = 1 GROUP BY ALL) SELECT dataset, round(max(v) / sum(v), 6) AS top1_agreement, round(sum(m) / sum(v), 8) AS margin FROM v GROUP BY ALL")
def r6_confidence(spark, sf_dir):
    c = R.confidence(_means(spark, sf_dir))
    return c.select("dataset", F.round("top1_agreement", 6).alias("top1_agreement"), F.round("margin", 8).alias("margin"))


@query(sql("grade", f"SELECT 'a1_max' AS rule, * FROM ({_pick('a1 DESC')}) UNION ALL SELECT 'a4_min', * FROM ({_pick('a4')}) UNION ALL SELECT 'probe', * FROM ({_pick('pseudo DESC')})"))
def r7_r9_criterion_picks(spark, sf_dir):
    g = base.grade(spark, sf_dir)
    rules = (("a1_max", "a1", False), ("a4_min", "a4", True), ("probe", "pseudo", False))
    parts = [R.pick(g, F.col(c), asc).select(F.lit(n).alias("rule"), "dataset", "detector") for n, c, asc in rules]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


_BEST = "SELECT {by}, detector FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY m, detector) AS k FROM (SELECT {by}, detector, round(avg(g), 9) AS m FROM (SELECT *, max(truth) OVER (PARTITION BY dataset) - truth AS g FROM grade) GROUP BY ALL)) WHERE k = 1"


@query(sql("grade", f"WITH f AS ({_BEST.format(by='modality')}), r AS (SELECT dataset, modality, max(truth) AS oracle_best, min(truth) AS anti_oracle, round(avg(truth), 11) AS random FROM grade GROUP BY ALL) SELECT r.dataset, oracle_best, anti_oracle, random, g.truth AS global_fixed FROM r JOIN f USING (modality) JOIN grade g ON g.dataset = r.dataset AND g.detector = f.detector"))
def r8_r20_references_and_best_fixed(spark, sf_dir):
    g = base.grade(spark, sf_dir)
    fixed = R.best_fixed(g, ["modality"])
    chosen = g.join(fixed, ["modality", "detector"]).select("dataset", F.col("truth").alias("global_fixed"))
    return R.references(g).withColumn("random", F.round("random", 11)).join(chosen, "dataset")


@query(sql("grade", "WITH l AS (SELECT *, max(a1) OVER (PARTITION BY dataset) - max(a4) OVER (PARTITION BY dataset) AS l FROM grade) " + _pick("CASE WHEN l > -0.14 THEN a1 ELSE a4 END DESC", "l")))
def r10_matched_router(spark, sf_dir):
    return R.matched_router(base.grade(spark, sf_dir))


@query(sql("grade", "WITH l AS (SELECT *, 1 / (1 + exp(-10.0 * (max(a1) OVER (PARTITION BY dataset) - max(a4) OVER (PARTITION BY dataset)))) AS s FROM grade) " + _pick("round(s * a1 + (1 - s) * a4, 9) DESC", "l")))
def r11_alpha_router(spark, sf_dir):
    return R.alpha_router(base.grade(spark, sf_dir))


_MIXES = """WITH s AS (SELECT *, round(alpha * a1 + (1 - alpha) * a4, 9) AS c FROM grade, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS alpha)),
k AS (SELECT *, row_number() OVER w AS k, round(stddev_pop(c) OVER (PARTITION BY dataset, alpha), 9) AS spread, round(c - lead(c) OVER w, 9) AS margin FROM s WINDOW w AS (PARTITION BY dataset, alpha ORDER BY c DESC, detector)),
t AS (SELECT * FROM k WHERE k = 1), v AS (SELECT dataset, detector, count(*) AS n, min(alpha) AS alpha FROM t GROUP BY ALL)
SELECT dataset, 'disagreement' AS rule, detector FROM t QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY spread DESC, alpha) = 1
UNION ALL SELECT dataset, 'margin', detector FROM t QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY margin DESC NULLS LAST, alpha) = 1
UNION ALL SELECT dataset, 'consensus', detector FROM v QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, alpha) = 1
UNION ALL SELECT dataset, 'oracle', detector FROM t QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY truth DESC, alpha) = 1"""


@query(sql("grade", _MIXES))
def r11_alpha_estimators(spark, sf_dir):
    return R.alpha_estimators(base.grade(spark, sf_dir))


@query()
def r11_learned_router(spark, sf_dir):
    g = base.grade(spark, sf_dir).groupBy("dataset").agg(F.max("a1").alias("m1"), F.max("a4").alias("m4"), F.avg("pseudo").alias("mp"), F.max("truth").alias("best"))
    return R.learned_router(g, ("m1", "m4", "mp"), "best")


@query(sql("grade", "WITH s AS (SELECT dataset, round(avg(pseudo), 9) AS f FROM grade GROUP BY ALL), r AS (SELECT dataset, f > (SELECT quantile_cont(f, 0.5) FROM s) AS r FROM s), l AS (SELECT * FROM grade JOIN r USING (dataset)) " + _pick("CASE WHEN r THEN a1 ELSE a4 END DESC", "l")))
def r12_correlation_router(spark, sf_dir):
    g = base.grade(spark, sf_dir)
    return R.correlation_router(g, g.groupBy("dataset").agg(F.round(F.avg("pseudo"), 9).alias("f")), "f")


@query(sql("grade", "WITH c AS (SELECT *, round(alpha * a1 + (1 - alpha) * a4, 9) AS c FROM grade, (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS alpha)), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dataset, alpha ORDER BY c DESC, detector) = 1) SELECT dataset, alpha FROM b QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY truth DESC, alpha) = 1"))
def r13_few_shot_alpha(spark, sf_dir):
    g = base.grade(spark, sf_dir)
    return R.few_shot_alpha(g.select("dataset", "detector", "a1", "a4"), (0.0, 0.5, 1.0), g.select("dataset", "detector", F.col("truth").alias("seen")))


@query(sql("fact", f"WITH r AS (SELECT *, {AVG('dataset, subset', 'pseudo', ' DESC')} AS r FROM fact), g AS (SELECT dataset, detector, round(sum(r), 9) AS b, round(avg(pseudo), 9) AS m FROM r GROUP BY ALL) SELECT x.dataset, x.detector AS borda_pick, y.detector AS mean_pick FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY b, detector) = 1) x JOIN (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY m DESC, detector) = 1) y USING (dataset)"))
def r14_injection_borda(spark, sf_dir):
    return R.injection_borda(base.fact(spark, sf_dir))


_RULES = f"r AS (SELECT *, {AVG('dataset, subset', 'pseudo', ' DESC')} AS r, stddev_pop(pseudo) OVER (PARTITION BY dataset, subset) AS d, row_number() OVER o AS k, pseudo - coalesce(lead(pseudo) OVER o, pseudo) AS g FROM fact WINDOW o AS (PARTITION BY dataset, subset ORDER BY pseudo DESC, detector)), g AS (SELECT dataset, detector, round(sum(r), 9) AS borda, max(r) AS worst, round(sum(ln(r)), 9) AS product, round(sum(r * d), 9) AS discriminative FROM r GROUP BY ALL)"


@query(sql("fact", f"WITH {_RULES} " + " UNION ALL ".join(f"SELECT dataset, '{c}' AS rule, detector FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {c}, detector) = 1)" for c in ("borda", "worst", "product", "discriminative")) + " UNION ALL " + " UNION ALL ".join(f"SELECT dataset, '{n}', detector FROM (SELECT * FROM r WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY round({c}, 9) DESC, subset) = 1)" for n, c in (("confidence", "d"), ("margin", "g")))))
def r15_probe_combination(spark, sf_dir):
    return R.combine_probes(base.fact(spark, sf_dir))


@query(sql("grade", "WITH g AS (SELECT *, max(CASE WHEN detector = 'k1' THEN truth END) OVER (PARTITION BY dataset) AS d FROM grade) SELECT dataset, CASE WHEN d IS NOT NULL AND truth - d < 0.05 THEN 'k1' ELSE detector END AS detector FROM g QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY truth DESC, detector = 'k1' DESC, detector) = 1"))
def r16_label_selection(spark, sf_dir):
    g = base.grade(spark, sf_dir).select("dataset", "detector", F.col("truth").alias("share"))
    return R.label_selection(g, "k1")


_BELOW = "SELECT dataset, detector, row_id, (sum(1 - y) OVER w - sum(1 - y) OVER v / 2.0) / sum(1 - y) OVER u AS share, sum(1 - y) OVER u - sum(1 - y) OVER w + sum(1 - y) OVER v AS over, sum(1 - y) OVER u AS n FROM point WINDOW u AS (PARTITION BY dataset, detector), v AS (PARTITION BY dataset, detector, score), w AS (PARTITION BY dataset, detector ORDER BY score RANGE UNBOUNDED PRECEDING)"


@query(sql("point", f"WITH b AS ({_BELOW}) SELECT a.dataset, a.row_id, round((a.share + z.share) / 2, 9) AS score FROM b a JOIN b z ON a.dataset = z.dataset AND a.row_id = z.row_id AND a.detector = 'x1' AND z.detector = 'x3'"))
def r17_j8_hedge(spark, sf_dir):
    p = base.point(spark, sf_dir)
    s = R.share_below(p, p.where("y = 0"), ["dataset", "detector"])
    return R.hedge(s.where("detector = 'x1'"), s.where("detector = 'x3'")).withColumn("score", F.round("score", 9))


@query(sql("point", f"WITH b AS ({_BELOW}) SELECT dataset, row_id, round(max(-ln((1 + over) / (n + 1.0))), 6) AS largest, round(avg(-ln((1 + over) / (n + 1.0))), 6) AS mean FROM b GROUP BY ALL"))
def r18_calibrated_portfolio(spark, sf_dir):
    p = base.point(spark, sf_dir)
    return R.portfolio(p, p.where("y = 0")).select("dataset", "row_id", F.round("largest", 6).alias("largest"), F.round("mean", 6).alias("mean"))


@query()
def r18_portfolio_of_detectors(spark, sf_dir):
    """The calibrated portfolio of an outlier factor, a copula, principal axes and histograms, fitted on the normals."""
    rows = base.tab(spark, sf_dir)
    scores = D.fit_and_score(rows.where("y = 0"), rows, FEATURES, ["COPOD", "HBOS_10", "LOF_k10", "PCA_0.9"])
    scores = stored(scores.withColumn("score", F.round("score", 9)), "portfolio")
    p = R.portfolio(scores, scores.join(rows.where("y = 0").select("dataset", "row_id"), ["dataset", "row_id"], "left_semi"))
    return p.select("dataset", "row_id", F.round("largest", 4).alias("largest"), F.round("mean", 4).alias("mean"))


@query(sql("point", "WITH s AS (SELECT dataset, row_id, score, quantile_cont(score, 0.5) OVER (PARTITION BY dataset) AS m FROM point WHERE detector = 'x1') SELECT 'iid' AS mode, dataset, row_id FROM s QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5('6:' || row_id)) <= 50 UNION ALL SELECT 'caught', dataset, row_id FROM s QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score DESC, row_id) <= 50 UNION ALL (SELECT 'missed', dataset, row_id FROM s WHERE score < m QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5('6:' || row_id)) <= 50)"))
def r19_acquisition_modes(spark, sf_dir):
    s = base.point(spark, sf_dir).where("detector = 'x1'").select("dataset", "row_id", "score")
    parts = [R.acquisition(s, m, 50, 6).select(F.lit(m).alias("mode"), "dataset", "row_id") for m in ("iid", "caught", "missed")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


# --- tests

_PAIR = f"SELECT dataset, modality, corpus, regret1, random_regret FROM ({_REGRET})"


@query(sql("grade", f"WITH p AS ({_PAIR}), d AS (SELECT modality, round(regret1 - random_regret, 12) AS d FROM p), r AS (SELECT *, {AVG('modality', 'abs(d)')} AS r, count(*) OVER (PARTITION BY modality, abs(d)) AS t FROM d WHERE d <> 0), g AS (SELECT modality, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, sum(t * t - 1) AS ties FROM r GROUP BY ALL) SELECT modality, n, w, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 6) AS z FROM g"))
def t1_wilcoxon_sums(spark, sf_dir):
    return T.wilcoxon_sums(_regrets(spark, sf_dir), ["modality"], "regret1", "random_regret").withColumn("z", F.round("z", 6))


@query()
def t1_wilcoxon_p(spark, sf_dir):
    return T.wilcoxon(_regrets(spark, sf_dir), ["corpus"], "regret1", "random_regret")


@query(sql("grade", "WITH p AS (SELECT modality, detector, round(avg(pseudo) / 20, 9) AS p FROM grade GROUP BY ALL), h AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY modality) - row_number() OVER (PARTITION BY modality ORDER BY p, detector) + 1) * p) AS h FROM p) SELECT modality, detector, round(h, 8) AS p_holm, round(max(h) OVER (PARTITION BY modality ORDER BY p, detector ROWS UNBOUNDED PRECEDING), 8) AS p_holm_monotone FROM h"))
def t2_holm(spark, sf_dir):
    p = base.grade(spark, sf_dir).groupBy("modality", "detector").agg(F.round(F.avg("pseudo") / 20, 9).alias("p"))
    h = T.holm(p, ["modality"], "detector", "p")
    return h.select("modality", "detector", F.round("p_holm", 8).alias("p_holm"), F.round("p_holm_monotone", 8).alias("p_holm_monotone"))


_DRAW = "('0x' || substr(md5('0:' || d || ':' || key), 1, 8))::BIGINT / 4294967296.0"
_BOOTSTRAP = f"""WITH p AS ({_PAIR}),
k AS (SELECT 'rows' AS kind, modality, dataset AS key, regret1 AS v FROM p UNION ALL SELECT 'clusters', modality, corpus, regret1 FROM p),
u AS (SELECT kind, modality, key, sum(v) AS s, count(v) AS c FROM k GROUP BY ALL),
a AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY kind, modality) AS n FROM u WINDOW w AS (PARTITION BY kind, modality ORDER BY key)),
x AS (SELECT kind, modality, d, floor({_DRAW} * n)::BIGINT AS place FROM a, range(2000) t(d)),
m AS (SELECT kind, modality, d, sum(s) / sum(c) AS m FROM x JOIN a USING (kind, modality, place) GROUP BY ALL),
i AS (SELECT kind, modality, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY ALL)
SELECT modality, kind, round(sum(s) / sum(c), 6) AS mean, round(max(low), 6) AS low, round(max(high), 6) AS high FROM u JOIN i USING (kind, modality) GROUP BY ALL"""


@query(sql("grade", _BOOTSTRAP))
def t3_bootstrap_intervals(spark, sf_dir):
    r = stored(_regrets(spark, sf_dir), "regrets")
    kinds = [T.bootstrap_mean(r, ["modality"], "regret1", key, 2000).withColumn("kind", F.lit(kind)) for kind, key in (("rows", "dataset"), ("clusters", "corpus"))]
    return kinds[0].unionByName(kinds[1]).select("modality", "kind", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


_FLIPS = f"""WITH p AS ({_PAIR}), u AS (SELECT modality, corpus AS key, sum(regret1 - random_regret) AS s, count(*) AS c FROM p GROUP BY ALL),
t AS (SELECT modality, d, abs(sum(CASE WHEN {_DRAW} < 0.5 THEN s ELSE -s END)) AS t FROM u, range(5000) r(d) GROUP BY ALL),
o AS (SELECT modality, sum(s) AS s, sum(c) AS c FROM u GROUP BY ALL)
SELECT modality, round(any_value(s / c), 6) AS mean, round((1 + count(*) FILTER (t >= abs(s) - 1e-9)) / 5001.0, 9) AS p FROM t JOIN o USING (modality) GROUP BY ALL"""


@query(sql("grade", _FLIPS))
def t4_cluster_sign_flip(spark, sf_dir):
    d = _regrets(spark, sf_dir).withColumn("d", F.col("regret1") - F.col("random_regret"))
    return T.sign_flip(d, ["modality"], "d", "corpus", 5000).select("modality", F.round("mean", 6).alias("mean"), F.round("p", 9).alias("p"))


@query(sql("grade", f"SELECT modality, round(avg(regret1 - random_regret) / stddev_samp(regret1 - random_regret), 6) AS dz, sum(CASE WHEN regret1 - random_regret > 1e-9 THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN abs(regret1 - random_regret) <= 1e-9 THEN 1 ELSE 0 END) AS ties, sum(CASE WHEN regret1 - random_regret < -1e-9 THEN 1 ELSE 0 END) AS losses FROM ({_PAIR}) GROUP BY ALL"))
def t5_paired_effect(spark, sf_dir):
    return T.paired_effect(_regrets(spark, sf_dir), ["modality"], "regret1", "random_regret").withColumn("dz", F.round("dz", 6))


@query(sql("grade", f"WITH p AS ({_PAIR}) SELECT c.corpus AS left_out, round(avg(regret1), 9) AS mean FROM (SELECT DISTINCT corpus FROM p) c JOIN p ON p.corpus <> c.corpus GROUP BY ALL"))
def t6_leave_one_source_out(spark, sf_dir):
    return T.leave_one_out(_regrets(spark, sf_dir), "corpus", "regret1").withColumn("mean", F.round("mean", 9))


@query(sql("grade", f"WITH a AS ({_pick('pseudo DESC')}), b AS ({_pick('truth DESC')}) SELECT a.detector AS probe, " + ", ".join(f"sum(CASE WHEN b.detector = 'k{i}' THEN 1 ELSE 0 END) AS k{i}" for i in range(1, 8)) + " FROM a JOIN b USING (dataset) GROUP BY ALL"))
def t7_confusion_matrix(spark, sf_dir):
    g = base.grade(spark, sf_dir)
    a, b = R.pick(g, F.col("pseudo"), least=1).withColumnRenamed("detector", "probe"), R.pick(g, F.col("truth"), least=1)
    return a.join(b, "dataset").groupBy("probe").pivot("detector", [f"k{i}" for i in range(1, 8)]).agg(F.count(F.lit(1))).na.fill(0)


@query(sql("fact", "WITH l AS (SELECT dataset, detector, subset, row_number() OVER (ORDER BY dataset, detector, subset) AS k FROM fact), r AS (SELECT pseudo, row_number() OVER (ORDER BY md5('8:' || dataset || ':' || detector || ':' || subset)) AS k FROM fact) SELECT dataset, detector, subset, pseudo FROM l JOIN r USING (k)"))
def t8_scrambled_control(spark, sf_dir):
    return T.scrambled(base.fact(spark, sf_dir), ["dataset", "detector", "subset"], "pseudo", 8)


@query(sql("grade", f"WITH n AS (SELECT DISTINCT detector AS left_out FROM grade), p AS (SELECT g.*, left_out FROM grade g JOIN n ON detector <> left_out), r AS (SELECT left_out, dataset, {AVG('left_out, dataset', 'pseudo')} AS a, {AVG('left_out, dataset', 'truth')} AS b FROM p), s AS (SELECT left_out, dataset, corr(a, b) AS rho FROM r GROUP BY ALL) SELECT left_out, round(avg(rho), 6) AS rho FROM s GROUP BY ALL"))
def t9_drop_one_detector(spark, sf_dir):
    p = T.drop_one(base.grade(spark, sf_dir), "detector")
    return M.spearman(p, ["left_out", "dataset"], "pseudo", "truth").groupBy("left_out").agg(F.round(F.avg("rho"), 6).alias("rho"))


@query(sql("fact", f"WITH r AS (SELECT subset, dataset, {AVG('subset, dataset', 'pseudo')} AS a, {AVG('subset, dataset', 'truth')} AS b FROM fact), s AS (SELECT subset, dataset, corr(a, b) AS rho FROM r GROUP BY ALL), m AS (SELECT subset, avg(rho) AS rho FROM s GROUP BY ALL) SELECT round(avg(rho), 6) AS mean, round(stddev_samp(rho), 6) AS std, count(*) AS seeds FROM m"))
def t10_multi_seed(spark, sf_dir):
    m = M.spearman(base.fact(spark, sf_dir), ["subset", "dataset"], "pseudo", "truth").groupBy("subset").agg(F.avg("rho").alias("rho"))
    return m.agg(F.round(F.avg("rho"), 6).alias("mean"), F.round(F.stddev_samp("rho"), 6).alias("std"), F.count(F.lit(1)).alias("seeds"))


@query(sql("grade", f"SELECT modality, round(1 - avg(regret1) / avg(random_regret), 9) AS gap FROM ({_PAIR}) GROUP BY ALL"))
def t11_gap_closed(spark, sf_dir):
    return T.gap_closed(_regrets(spark, sf_dir), ["modality"], "regret1", "random_regret").withColumn("gap", F.round("gap", 9))


# --- pseudo-label evaluation

_SIZES = f"WITH g AS ({_GRID}), c AS (SELECT dataset, cluster, count(*) AS size FROM g GROUP BY ALL), s AS (SELECT dataset, cluster, size FROM c QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY size, cluster) <= greatest(2, count(*) OVER (PARTITION BY dataset) // 2))"


@query(sql("tab", f"{_SIZES} SELECT * FROM s"))
def g1_smallest_half(spark, sf_dir):
    return G.candidates(E.composite_scores(_grid(spark, sf_dir)), "smallest")


@query()
def g1_composite_top_quartile(spark, sf_dir):
    c = E.composite_scores(_grid(spark, sf_dir))
    return G.candidates(c, "composite_top_quartile").withColumn("selection", F.lit("composite")).unionAll(G.candidates(c, "hard").withColumn("selection", F.lit("hard")))


_DRAWN = "d AS (SELECT dataset, subset, cluster, size FROM (SELECT s.dataset, i AS subset, cluster, size, coalesce(sum(size) OVER (PARTITION BY s.dataset, i ORDER BY md5('1:' || s.dataset || ':' || i || ':' || cluster) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, n FROM s JOIN (SELECT dataset, count(*) AS n FROM g GROUP BY ALL) USING (dataset), range(6) t(i)) WHERE b < greatest(20, floor(n * 0.05)))"


def _drawn(spark, sf_dir, n=6):
    g = _grid(spark, sf_dir)
    totals = g.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return g, G.draw_subsets(G.candidates(E.composite_scores(g), "smallest"), totals, n, 1)


@query(sql("tab", f"{_SIZES}, {_DRAWN} SELECT dataset, subset, cluster FROM d"))
def g2_drawn_clusters(spark, sf_dir):
    return _drawn(spark, sf_dir)[1]


def _members_sql(subsets: int) -> str:
    roles = "CASE WHEN a = 1 THEN 'pseudo_anom' WHEN k > n - least(greatest(50, floor(n * 0.2)), floor(n / 3)) THEN 'pseudo_norm' ELSE 'train' END"
    return (
        f"a AS (SELECT g.dataset, i AS subset, row_id, CASE WHEN d.cluster IS NULL THEN 0 ELSE 1 END AS a FROM g CROSS JOIN range({subsets}) t(i) "
        "LEFT JOIN d ON d.dataset = g.dataset AND d.subset = i AND d.cluster = g.cluster), "
        "k AS (SELECT *, row_number() OVER (PARTITION BY dataset, subset, a ORDER BY md5('1:' || subset || ':' || row_id)) AS k, count(*) OVER (PARTITION BY dataset, subset, a) AS n FROM a), "
        f"m AS (SELECT dataset, subset, row_id, {roles} AS role FROM k)"
    )


@query(sql("tab", f"{_SIZES}, {_DRAWN}, {_members_sql(6)} SELECT dataset, subset, row_id, role FROM m"))
def g2_subset_memberships(spark, sf_dir):
    g, d = _drawn(spark, sf_dir)
    return G.memberships(g, d, 6, 1)


GRADED = ["ECOD", "HBOS_20", "MaxZ"]


def _graded_sql(p: str, members: str, positive: str) -> str:
    """Expressions that end in {p}auc (d, detector, auc): the three detectors fitted on the train rows of each d of
    ``members`` (dataset, d, row_id, role), by the definitions of the detectors."""
    return f"""{p}u AS (SELECT d, row_id, role, feature, value FROM {members} JOIN feat USING (dataset, row_id)),
{p}t AS (SELECT d, feature, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi, count(*) AS n FROM {p}u WHERE role = 'train' GROUP BY ALL),
{p}s AS (SELECT d, feature, avg(((value - mean) / sd) ** 3) AS skew FROM {p}u JOIN {p}t USING (d, feature) WHERE role = 'train' GROUP BY ALL),
{p}b AS (SELECT d, row_id, role, feature, n, CASE WHEN hi = lo THEN 1 ELSE least(greatest(floor((value - lo) / (hi - lo) * 20)::INT + 1, 1), 20) END AS bin FROM {p}u JOIN {p}t USING (d, feature)),
{p}h AS (SELECT d, feature, bin, count(*) / max(n) * 20 AS density FROM {p}b WHERE role = 'train' GROUP BY ALL),
{p}w AS (SELECT d, row_id, role, feature, sum((role = 'train')::INT) OVER (PARTITION BY d, feature ORDER BY value RANGE UNBOUNDED PRECEDING) AS le, sum((role = 'train')::INT) OVER (PARTITION BY d, feature ORDER BY value DESC RANGE UNBOUNDED PRECEDING) AS ge FROM {p}u),
{p}e AS (SELECT d, row_id, role, -ln((le + 1) / (n + 1)) AS l, -ln((ge + 1) / (n + 1)) AS r, skew FROM {p}w JOIN {p}t USING (d, feature) JOIN {p}s USING (d, feature)),
{p}all AS (SELECT d, row_id, role, 'MaxZ' AS detector, max(abs((value - mean) / (sd + 1e-9))) AS x FROM {p}u JOIN {p}t USING (d, feature) GROUP BY ALL
 UNION ALL SELECT d, row_id, role, 'HBOS_20', sum(-ln(coalesce(density, 0) + 1e-6)) FROM {p}b LEFT JOIN {p}h USING (d, feature, bin) GROUP BY ALL
 UNION ALL SELECT d, row_id, role, 'ECOD', greatest(sum(l), sum(r), sum(CASE WHEN skew < 0 THEN l ELSE r END)) FROM {p}e GROUP BY ALL),
{p}x AS (SELECT d, detector, CASE WHEN role = '{positive}' THEN 1 ELSE 0 END AS y, round(x, 5) AS x FROM {p}all WHERE role <> 'train'),
{p}r AS (SELECT *, {AVG('d, detector', 'x')} AS k FROM {p}x),
{p}auc AS (SELECT d, detector, (sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y)::DOUBLE * sum(1 - y), 0) AS auc FROM {p}r GROUP BY ALL)"""


_PSEUDO = f"{_SIZES}, {_DRAWN.replace('range(6)', 'range(5)')}, {_members_sql(5)}, q AS (SELECT *, dataset || '/' || subset AS d FROM m), {_graded_sql('p', 'q', 'pseudo_anom')}"
_TRUE = f"""o AS (SELECT *, row_number() OVER (PARTITION BY dataset, y ORDER BY md5('3:' || row_id)) AS k, count(*) OVER (PARTITION BY dataset, y) AS n FROM tab),
v AS (SELECT dataset, dataset AS d, row_id, CASE WHEN y = 1 THEN 'anom' WHEN k <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS role FROM o), {_graded_sql('v', 'v', 'anom')}"""
_COUNTED = "cn AS (SELECT dataset, subset, d, sum((role = 'train')::INT) AS n_train, sum((role = 'pseudo_anom')::INT) AS n_anom, sum((role = 'pseudo_norm')::INT) AS n_norm FROM q GROUP BY ALL)"


@query(sql("feat", f"{_PSEUDO}, {_COUNTED} SELECT dataset, subset, detector, n_train, n_anom, n_norm, round(auc, 6) AS pseudo_auc FROM cn JOIN pauc USING (d)"))
def g3_pseudo_auc(spark, sf_dir):
    g, d = _drawn(spark, sf_dir, 5)
    members = G.memberships(g, d, 5, 1)
    return G.pseudo_auc(base.tab(spark, sf_dir), members, FEATURES, GRADED, digits=5).withColumn("pseudo_auc", F.round("pseudo_auc", 6))


@query(sql("feat", f"WITH {_TRUE} SELECT d AS dataset, detector, round(auc, 6) AS true_auc FROM vauc"))
def g4_true_ranking(spark, sf_dir):
    return G.true_quality(base.tab(spark, sf_dir), FEATURES, GRADED, 3, 5).select("dataset", "detector", F.round("true_auc", 6).alias("true_auc"))


_V1 = f"""{_PSEUDO}, {_TRUE}, z AS (SELECT split_part(d, '/', 1) AS dataset, detector, round(avg(auc), 9) AS mean_pseudo_auc FROM pauc GROUP BY ALL),
zz AS (SELECT z.dataset, z.detector, mean_pseudo_auc, vauc.auc AS true_auc FROM z JOIN vauc ON z.dataset = vauc.d AND z.detector = vauc.detector WHERE vauc.auc IS NOT NULL AND mean_pseudo_auc IS NOT NULL),
zr AS (SELECT *, {AVG('dataset', 'mean_pseudo_auc', ' DESC')} AS pseudo_rank, {AVG('dataset', 'true_auc', ' DESC')} AS true_rank FROM zz)
SELECT dataset, detector, round(mean_pseudo_auc, 6) AS mean_pseudo_auc, round(true_auc, 6) AS true_auc, pseudo_rank, true_rank, round(corr(pseudo_rank, true_rank) OVER (PARTITION BY dataset), 6) AS rho FROM zr"""


@query(sql("feat", _V1))
def flagship_v1_ranking(spark, sf_dir):
    """The whole pipeline: clusters, composite scores, subsets, pseudo-AUC, the true ranking, and the correlation of the two."""
    g, d = _drawn(spark, sf_dir, 5)
    rows = base.tab(spark, sf_dir)
    pseudo = G.pseudo_auc(rows, G.memberships(g, d, 5, 1), FEATURES, GRADED, digits=5)
    r = G.v1_ranking(pseudo, G.true_quality(rows, FEATURES, GRADED, 3, 5))
    return r.select("dataset", "detector", *[F.round(c, 6).alias(c) for c in ("mean_pseudo_auc", "true_auc")], "pseudo_rank", "true_rank", F.round("rho", 6).alias("rho"))


FAMILIES = ["CBLOF_8", "COPOD", "ECOD", "HBOS_10", "IForest_100", "KNN_k5", "LODA_10", "LOF_k20", "PCA_0.9"]


@query()
def v1_families_on_clusters(spark, sf_dir):
    """The whole pipeline over embedded and clustered normals, with a detector of each family and three aggregations of subsets."""
    rows = base.tab(spark, sf_dir)
    z = E.embed(rows.where("y = 0"), FEATURES)
    g = stored(E.kmeans(z.select("dataset", "row_id", "z"), 20), "clusters")
    totals = g.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    drawn = G.draw_subsets(G.candidates(E.composite_scores(g), "smallest"), totals, 3, 1)
    pseudo = stored(G.pseudo_auc(rows, G.memberships(g, drawn, 3, 1), FEATURES, FAMILIES, digits=5), "pseudo")
    ranks = R.aggregate_ranks(pseudo, "pseudo_auc")
    truth = G.true_quality(rows, FEATURES, FAMILIES, 3, 5).where("true_auc IS NOT NULL")
    both = stored(ranks.join(truth.select("dataset", "detector", "true_auc"), ["dataset", "detector"]), "both")
    rho = M.spearman(both, ["dataset", "aggregation"], "score", "true_auc")
    out = both.join(rho, ["dataset", "aggregation"], "left")
    return out.select("dataset", "aggregation", "detector", "rank", *[F.round(c, 3).alias(c) for c in ("score", "true_auc", "rho")])


@query()
def g5_geometry_baseline(spark, sf_dir):
    g, d = _drawn(spark, sf_dir, 1)
    pool = spark.createDataFrame([(n,) for n in D.pool()], "detector string")
    return G.geometry_baseline(G.memberships(g, d, 1, 1), G.edge_tags(g).select("dataset", "row_id", "distance"), pool)


@query("SELECT s || '_K' || k AS regime, s AS selection, k FROM (SELECT unnest(['smallest', 'random', 'hard']) AS s), (SELECT unnest([30, 50]) AS k)")
def g6_regime_bank(spark, sf_dir):
    return G.regimes(("smallest", "random", "hard"), (30, 50), spark)


@query()
def g6_regime_scores(spark, sf_dir):
    """All six cells of the bank over two clusterings, graded with the three detectors."""
    rows = base.tab(spark, sf_dir)
    z = E.embed(rows, FEATURES)
    clustered = {k: E.kmeans(z, k) for k in (30, 50)}
    r = G.regime_scores(rows, clustered, ("smallest", "random", "hard"), FEATURES, GRADED, 5, 1, 5)
    return r.withColumn("pseudo_auc", F.round("pseudo_auc", 6))


@query(sql("zfeat", "WITH m AS (SELECT dataset, row_id, round(avg(abs(z)), 9) AS z FROM zfeat GROUP BY ALL), p AS (SELECT *, percent_rank() OVER (PARTITION BY dataset ORDER BY z DESC, row_id) AS p FROM m) SELECT dataset, row_id FROM p WHERE p < 0.25"))
def g7_global_tail(spark, sf_dir):
    return G.global_tail(base.tab(spark, sf_dir), FEATURES)


@query(sql("feat", "WITH n AS (SELECT DISTINCT dataset, feature FROM feat), o AS (SELECT dataset, i AS bank, feature, md5('2:' || dataset || ':' || i || ':' || feature) AS o FROM n, range(5) t(i)), p AS (SELECT *, ('0x' || substr(o, 32, 1))::INT % 2 = 0 AS low FROM o QUALIFY row_number() OVER (PARTITION BY dataset, bank ORDER BY o) = 1), q AS (SELECT dataset, feature, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM feat GROUP BY ALL) SELECT f.dataset, bank, row_id FROM feat f JOIN p USING (dataset, feature) JOIN q USING (dataset, feature) WHERE CASE WHEN low THEN value <= lo ELSE value >= hi END"))
def g8_marginal_tail(spark, sf_dir):
    return G.marginal_tail(base.long(base.tab(spark, sf_dir)), 5, 2)


@query(sql("tab", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY dataset, y ORDER BY md5('4:' || row_id)) AS k, sum(1 - y) OVER (PARTITION BY dataset) AS n FROM tab), r AS (SELECT unnest([0.0, 0.005, 0.01, 0.02, 0.05, -1.0])::DOUBLE AS rate) SELECT dataset, rate, row_id, y FROM k, r WHERE y = 0 OR rate < 0 OR k <= floor(rate * n)"))
def g9_contamination(spark, sf_dir):
    return G.contaminate(base.tab(spark, sf_dir), (0.0, 0.005, 0.01, 0.02, 0.05, -1.0), 4)


def _held_sql(chosen: str, but: str = "") -> str:
    """Expressions that end in q (dataset, unit, d, row_id, role) for chosen (dataset, unit, row_id), without the rows of ``but``."""
    roles = "CASE WHEN a = 1 THEN 'pseudo_anom' WHEN k > n - least(greatest(50, floor(n * 0.2)), floor(n / 3)) THEN 'pseudo_norm' ELSE 'train' END"
    left = f" WHERE c.row_id IS NOT NULL OR (t.dataset, t.row_id) NOT IN (SELECT (dataset, row_id) FROM {but})" if but else ""
    return f"""un AS (SELECT DISTINCT dataset, unit FROM {chosen}),
al AS (SELECT t.dataset, un.unit, t.row_id, CASE WHEN c.row_id IS NULL THEN 0 ELSE 1 END AS a FROM tab t JOIN un ON t.dataset = un.dataset LEFT JOIN {chosen} c ON c.dataset = t.dataset AND c.unit = un.unit AND c.row_id = t.row_id{left}),
kk AS (SELECT *, row_number() OVER (PARTITION BY dataset, unit, a ORDER BY md5('6:' || unit || ':' || row_id)) AS k, count(*) OVER (PARTITION BY dataset, unit, a) AS n FROM al),
q AS (SELECT dataset, unit, dataset || '/' || unit AS d, row_id, {roles} AS role FROM kk), {_graded_sql('p', 'q', 'pseudo_anom')}"""


_UNITS = "SELECT un.dataset, un.unit AS {unit}, detector, round(auc, 6) AS pseudo_auc FROM un JOIN pauc ON d = dataset || '/' || unit"
_TAILS = """m AS (SELECT dataset, row_id, round(avg(abs(z)), 9) AS z FROM zfeat GROUP BY ALL),
pool AS (SELECT dataset, row_id FROM m QUALIFY percent_rank() OVER (PARTITION BY dataset ORDER BY z DESC, row_id) < 0.25),
ch AS (SELECT dataset, i AS unit, row_id FROM pool, range(3) t(i) QUALIFY row_number() OVER (PARTITION BY dataset, i ORDER BY md5('6:' || i || ':' || row_id)) <= (SELECT greatest(20, floor(count(*) * 0.05)) FROM tab o WHERE o.dataset = pool.dataset))"""


@query(sql("zfeat", f"WITH {_TAILS}, {_held_sql('ch', 'pool')} {_UNITS.format(unit='subset')}"))
def g7_global_tail_graded(spark, sf_dir):
    rows = stored(base.tab(spark, sf_dir), "rows")
    members = G.tail_subsets(rows, G.global_tail(rows, FEATURES), 3, 6)
    return G.pseudo_auc(rows, members, FEATURES, GRADED, digits=5).select("dataset", "subset", "detector", F.round("pseudo_auc", 6).alias("pseudo_auc"))


_BANKS = """nn AS (SELECT DISTINCT dataset, feature FROM feat), oo AS (SELECT dataset, i AS unit, feature, md5('2:' || dataset || ':' || i || ':' || feature) AS o FROM nn, range(3) t(i)),
pp AS (SELECT *, ('0x' || substr(o, 32, 1))::INT % 2 = 0 AS low FROM oo QUALIFY row_number() OVER (PARTITION BY dataset, unit ORDER BY o) = 1),
qq AS (SELECT dataset, feature, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM feat GROUP BY ALL),
ca AS (SELECT f.dataset, unit, row_id FROM feat f JOIN pp USING (dataset, feature) JOIN qq USING (dataset, feature) WHERE CASE WHEN low THEN value <= lo ELSE value >= hi END),
ch AS (SELECT * FROM ca QUALIFY count(*) OVER (PARTITION BY dataset, unit) BETWEEN 5 AND (SELECT count(*) / 2 FROM tab o WHERE o.dataset = ca.dataset))"""


@query(sql("feat", f"WITH {_BANKS}, {_held_sql('ch')} {_UNITS.format(unit='bank')}"))
def g8_marginal_tail_graded(spark, sf_dir):
    """Banks of fewer than 5 rows, or of over half a data set, are left out."""
    rows = stored(base.tab(spark, sf_dir), "rows")
    tails = stored(G.marginal_tail(base.long(rows), 3, 2), "tails")
    sizes = tails.groupBy("dataset", "bank").agg(F.count(F.lit(1)).alias("n")).join(rows.groupBy("dataset").agg((F.count(F.lit(1)) / 2).alias("half")), "dataset")
    tails = tails.join(sizes.where("n >= 5 AND n <= half").select("dataset", "bank"), ["dataset", "bank"])
    members = G.roles_of(rows, tails, ["bank"], 6)
    return G.pseudo_auc(rows, members, FEATURES, GRADED, ("dataset", "bank"), 5).select("dataset", "bank", "detector", F.round("pseudo_auc", 6).alias("pseudo_auc"))


@query()
def g9_contamination_regret(spark, sf_dir):
    """The pick's regret when unlabelled anomalies are left among the rows, by their rate; -1 is all of them."""
    rows = stored(base.tab(spark, sf_dir), "rows")
    mixed = G.contaminate(rows, (0.0, 0.01, 0.05, -1.0), 4)
    grid = _grid(spark, sf_dir).drop("y").join(mixed.select("dataset", "rate", "row_id"), ["dataset", "row_id"])
    unit = F.concat_ws("|", F.col("dataset"), F.col("rate").cast("string"))
    grid = stored(grid.withColumn("dataset", unit).drop("rate"), "mixed")
    totals = grid.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    members = G.memberships(grid, G.draw_subsets(G.candidates(E.composite_scores(grid), "smallest"), totals, 3, 1), 3, 1)
    members = members.select(F.substring_index("dataset", "|", 1).alias("dataset"), F.substring_index("dataset", "|", -1).cast("double").alias("rate"), "subset", "row_id", "role")
    pseudo = G.pseudo_auc(rows, members, FEATURES, GRADED, ("dataset", "rate", "subset"), 5)
    return G.regrets(pseudo, G.true_quality(rows, FEATURES, GRADED, 3, 5), ["rate"])


@query()
def g10_usable_subsets(spark, sf_dir):
    g, d = _drawn(spark, sf_dir)
    return G.usable_subsets(G.memberships(g, d, 6, 1))


_QUALITY = _PSEUDO.replace(_GRID, _GRID + " WHERE y = 0").replace("q AS (SELECT *, dataset || '/' || subset AS d FROM m)", "q AS (SELECT *, dataset || '/' || subset AS d FROM m WHERE (dataset, subset) IN (SELECT (dataset, subset) FROM m GROUP BY dataset, subset HAVING count(*) >= 60 AND sum((role = 'pseudo_anom')::INT) >= 3 AND sum((role = 'pseudo_norm')::INT) >= 3 AND sum((role = 'train')::INT) >= 20))")


@query(sql("feat", f"{_QUALITY} SELECT split_part(d, '/', 1) AS dataset, detector, round(avg(auc), 6) AS quality, count(auc) AS subsets FROM pauc GROUP BY ALL"))
def g10_subset_quality(spark, sf_dir):
    normals = _grid(spark, sf_dir).where("y = 0")
    totals = normals.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    drawn = G.draw_subsets(G.candidates(E.composite_scores(normals), "smallest"), totals, 5, 1)
    return G.subset_quality(base.tab(spark, sf_dir).where("y = 0"), G.memberships(normals, drawn, 5, 1), FEATURES, GRADED, 5).withColumn("quality", F.round("quality", 6))


_EDGE = f"g AS ({_GRID}), c AS (SELECT dataset, cluster, avg(p) AS cp, avg(q) AS cq FROM g GROUP BY ALL), t AS (SELECT g.dataset, row_id, g.cluster, sqrt((p - cp) ** 2 + (q - cq) ** 2) AS d FROM g JOIN c USING (dataset, cluster)), e AS (SELECT *, percent_rank() OVER (PARTITION BY dataset, cluster ORDER BY round(d, 9), row_id) AS share FROM t)"


@query(sql("tab", f"WITH {_EDGE} SELECT dataset, row_id, cluster, round(d, 6) AS distance, round(share, 9) AS share FROM e"))
def g15_edge_tags(spark, sf_dir):
    return G.edge_tags(_grid(spark, sf_dir)).withColumn("distance", F.round("distance", 6)).withColumn("share", F.round("share", 9))


_MEASURES = f"""WITH g AS ({_GRID}), t AS (SELECT dataset, avg(p) AS mp, stddev_pop(p) + 1e-9 AS sp, avg(q) AS mq, stddev_pop(q) + 1e-9 AS sq, count(*) AS n, sum(p) AS p1, sum(q) AS q1, sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq FROM g GROUP BY ALL),
x AS (SELECT g.dataset, cluster, round(sqrt(((p - mp) / sp) ** 2 + ((q - mq) / sq) ** 2), 9) AS r FROM g JOIN t USING (dataset)),
o AS (SELECT x.dataset, cluster, avg((r > cut)::INT) AS outer_ FROM x JOIN (SELECT dataset, quantile_cont(r, 0.9) AS cut FROM x GROUP BY ALL) USING (dataset) GROUP BY ALL),
c AS (SELECT dataset, cluster, count(*) AS m, avg(p) AS cp, avg(q) AS cq, sum(p) AS p1, sum(q) AS q1, sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq FROM g GROUP BY ALL),
r AS (SELECT c.*, t.n, mp, sp, mq, sq, n - m AS k, (t.p1 - c.p1) / (n - m) AS rp, (t.q1 - c.q1) / (n - m) AS rq, (t.pp - c.pp) / (n - m) AS app, (t.pq - c.pq) / (n - m) AS apq, (t.qq - c.qq) / (n - m) AS aqq FROM c JOIN t USING (dataset)),
s AS (SELECT *, app - rp * rp AS a, apq - rp * rq AS b, aqq - rq * rq AS d, pp / m - 2 * cp * rp + rp * rp AS s11, pq / m - cp * rq - rp * cq + rp * rq AS s12, qq / m - 2 * cq * rq + rq * rq AS s22 FROM r),
l AS (SELECT *, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) AS l FROM s),
v AS (SELECT *, (b * b * s11 + 2 * b * (l - a) * s12 + (l - a) * (l - a) * s22) / (b * b + (l - a) * (l - a)) / (l + 1e-12) AS recon FROM l),
w AS (SELECT v.dataset, v.cluster, count(*) FILTER (round(g.p, 9) < round(cp, 9)) / count(*) AS bp, count(*) FILTER (round(g.q, 9) < round(cq, 9)) / count(*) AS bq FROM v JOIN g ON g.dataset = v.dataset GROUP BY ALL)
SELECT v.dataset, v.cluster, m AS size, round(sqrt((((cp - mp) / sp) ** 2 + ((cq - mq) / sq) ** 2) / 2), 6) AS centroid, round(outer_, 6) AS "outer", round(abs(bp - 0.5) + abs(bq - 0.5), 6) AS marginal, round(recon, 4) AS recon
FROM v JOIN o USING (dataset, cluster) JOIN w USING (dataset, cluster)"""


@query(sql("tab", _MEASURES))
def g15_edge_measures(spark, sf_dir):
    g = _grid(spark, sf_dir).select("dataset", "row_id", "cluster", F.col("z")[0].alias("p"), F.col("z")[1].alias("q"))
    e = G.edge_measures(g, ("p", "q"))
    return e.select("dataset", "cluster", "size", *[F.round(c, 6).alias(c) for c in ("centroid", "outer", "marginal")], F.round("recon", 4).alias("recon"))


@query(sql("tab", f"WITH {_EDGE}, z AS (SELECT dataset, cluster FROM g GROUP BY ALL HAVING count(*) < 100) SELECT e.dataset, row_id, CASE WHEN share >= 0.9 THEN 'peripheral' WHEN z.cluster IS NOT NULL THEN 'small' ELSE 'embedded' END AS channel FROM e LEFT JOIN z USING (dataset, cluster)"))
def g11_two_channels(spark, sf_dir):
    g = _grid(spark, sf_dir)
    small = g.groupBy("dataset", "cluster").agg(F.count(F.lit(1)).alias("n")).where("n < 100")
    return G.two_channels(G.edge_tags(g), small)


_CHANNELS = f"{_EDGE}, zz AS (SELECT dataset, cluster FROM g GROUP BY ALL HAVING count(*) < 100), ch AS (SELECT * FROM (SELECT e.dataset, CASE WHEN share >= 0.9 THEN 'peripheral' WHEN zz.cluster IS NOT NULL THEN 'small' END AS unit, row_id FROM e LEFT JOIN zz USING (dataset, cluster)) WHERE unit IS NOT NULL)"


@query(sql("feat", f"WITH {_CHANNELS}, {_held_sql('ch')} {_UNITS.format(unit='channel')}"))
def g11_g15_channels_graded(spark, sf_dir):
    """The peripheral rows of clusters, and the rows of small clusters, as pseudo-anomalies."""
    rows, g = stored(base.tab(spark, sf_dir), "rows"), _grid(spark, sf_dir)
    small = g.groupBy("dataset", "cluster").agg(F.count(F.lit(1)).alias("n")).where("n < 100")
    chosen = G.two_channels(G.edge_tags(g), small).where("channel <> 'embedded'")
    members = G.roles_of(rows, chosen, ["channel"], 6)
    return G.pseudo_auc(rows, members, FEATURES, GRADED, ("dataset", "channel"), 5).select("dataset", "channel", "detector", F.round("pseudo_auc", 6).alias("pseudo_auc"))


@query(sql("grade", "WITH r AS (SELECT dataset, CASE WHEN detector <= 'k3' THEN 'peripheral' ELSE 'embedded' END AS channel, round(avg(pseudo), 9) AS regret FROM grade GROUP BY ALL) SELECT dataset, round(0.3 * sum(CASE WHEN channel = 'peripheral' THEN regret END) + (1 - 0.3) * sum(CASE WHEN channel = 'embedded' THEN regret END), 11) AS regret FROM r GROUP BY ALL"))
def g11_mixed_regret(spark, sf_dir):
    r = base.grade(spark, sf_dir).groupBy("dataset", F.expr("CASE WHEN detector <= 'k3' THEN 'peripheral' ELSE 'embedded' END").alias("channel")).agg(F.round(F.avg("pseudo"), 9).alias("regret"))
    return G.mixed_regret(r, 0.3).withColumn("regret", F.round("regret", 11))


@query(sql("tab", f"WITH g AS ({_GRID}), c AS (SELECT dataset, cluster, count(*) AS n FROM g GROUP BY ALL), s AS (SELECT dataset, cluster FROM c QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n, cluster) = 1) SELECT dataset, row_id FROM g JOIN s USING (dataset, cluster)"))
def g12_smallest_cluster(spark, sf_dir):
    return G.smallest_cluster(_grid(spark, sf_dir))


@query(sql("zfeat", "WITH d AS (SELECT dataset, row_id, round(sum(z * z), 6) AS d FROM zfeat GROUP BY ALL) SELECT dataset, row_id FROM d QUALIFY d >= quantile_cont(d, 0.95) OVER (PARTITION BY dataset)"))
def g12_farthest(spark, sf_dir):
    return G.farthest(base.tab(spark, sf_dir), FEATURES)


@query()
def g13_void_holdouts(spark, sf_dir):
    t, asked = base.tab(spark, sf_dir), base.asked(spark, sf_dir)
    parts = [G.void_holdout(t, FEATURES, k, seeds=asked.select("dataset", "row_id")).withColumn("kind", F.lit(k)) for k in ("knn", "dense", "radius")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(sql("tab", "WITH s AS (SELECT dataset, avg(x1) AS m1, stddev_pop(x1) AS s1, max(x1) AS h1, min(x1) AS l1 FROM tab GROUP BY ALL), d AS (SELECT unnest([0.0, 0.5, 1.0, 2.0, 4.0])::DOUBLE AS delta) SELECT dataset, delta, row_id, round(least(greatest(x1 + sign(x1 - m1) * delta * s1, l1), h1), 6) AS x1 FROM tab JOIN s USING (dataset), d WHERE y = 1"))
def g14_displaced_cluster(spark, sf_dir):
    t = base.tab(spark, sf_dir)
    return G.displace(t, t.where("y = 1").select("dataset", "row_id"), ("x1",), valid=True).withColumn("x1", F.round("x1", 6))


# --- synthetic rows

_U = "('0x' || substr(md5('{seed}:{tag}:' || {k}), 1, 8))::BIGINT / 4294967296.0"


def _u(seed, tag, k="k"):
    return _U.format(seed=seed, tag=tag, k=k)


_BASE = "n AS (SELECT dataset, row_id, x1, x2, x3, row_number() OVER (PARTITION BY dataset ORDER BY row_id) - 1 AS i, count(*) OVER (PARTITION BY dataset) AS n FROM tab WHERE y = 0), z AS (SELECT DISTINCT dataset, n FROM n)"
_THREE = ("x1", "x2", "x3")


def _normals(spark, sf_dir):
    return base.tab(spark, sf_dir).where("y = 0")


@query(sql("tab", f"WITH {_BASE}, d AS (SELECT dataset, k, floor({_u(1, 'base')} * n)::BIGINT AS b, floor({_u(1, 'donor0')} * n)::BIGINT AS e FROM z, range(200) t(k)), f AS (SELECT d.dataset, k, b.x1, b.x2, b.x3, e.x1 AS y1, e.x2 AS y2, e.x3 AS y3, list_transform(list_sort([{{'u': {_u(1, 'f:x1')}, 'f': 'x1'}}, {{'u': {_u(1, 'f:x2')}, 'f': 'x2'}}, {{'u': {_u(1, 'f:x3')}, 'f': 'x3'}}]), lambda x: x.f)[1:2] AS s FROM d JOIN n b ON d.dataset = b.dataset AND d.b = b.i JOIN n e ON d.dataset = e.dataset AND d.e = e.i) SELECT dataset, k, " + ", ".join(f"round(CASE WHEN list_contains(s, 'x{j}') THEN 0.25 * x{j} + 0.75 * y{j} ELSE x{j} END, 6) AS x{j}" for j in (1, 2, 3)) + " FROM f"))
def y1_feature_shuffle(spark, sf_dir):
    s = Y.shuffle_features(_normals(spark, sf_dir), _THREE, 200, 1, 2, alpha=0.75)
    return s.select("dataset", "k", *[F.round(f, 6).alias(f) for f in _THREE])


def _hist_sql(beta: float, share: float, observed: bool) -> str:
    rows = " UNION ALL ".join(f"SELECT dataset, row_id, 'x{j}' AS feature, x{j} AS value FROM n" for j in (1, 2, 3))
    new = "v.value" if observed else "h.a + h.bin * (h.b - h.a) / 30 + s.v * ((h.b - h.a) / 30)"
    extra = "LEFT JOIN v ON v.dataset = s.dataset AND v.feature = s.feature AND v.bin = h.bin AND v.k = (floor(s.v * h.c) + 1)::INT" if observed else ""
    return (
        f"WITH {_BASE}, l AS ({rows}), q AS (SELECT dataset, feature, quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM l GROUP BY ALL), "
        f"i AS (SELECT l.*, a, b, least(floor((value - a) / (b - a) * 30)::INT, 29) AS bin FROM l JOIN q USING (dataset, feature) WHERE value >= a AND value <= b AND b > a), "
        f"c AS (SELECT dataset, feature, bin, count(*) AS c, min(a) AS a, min(b) AS b FROM i GROUP BY ALL), w AS (SELECT *, (c / sum(c) OVER (PARTITION BY dataset, feature)) ** {beta} AS w FROM c), "
        f"h AS (SELECT *, sum(w) OVER (PARTITION BY dataset, feature ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY dataset, feature) AS upto FROM w), hh AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY dataset, feature ORDER BY bin), 0) AS since FROM h), "
        f"v AS (SELECT *, row_number() OVER (PARTITION BY dataset, feature, bin ORDER BY value, row_id) AS k FROM i), d AS (SELECT dataset, k, floor({_u(2, 'base')} * n)::BIGINT AS e FROM z, range(200) t(k)), "
        f"s AS (SELECT d.dataset, d.k, feature, value, ('0x' || substr(md5('2:do:' || feature || ':' || d.k), 1, 8))::BIGINT / 4294967296.0 < {share} AS doit, ('0x' || substr(md5('2:bin:' || feature || ':' || d.k), 1, 8))::BIGINT / 4294967296.0 AS u, ('0x' || substr(md5('2:in:' || feature || ':' || d.k), 1, 8))::BIGINT / 4294967296.0 AS v FROM d JOIN n ON d.dataset = n.dataset AND d.e = n.i JOIN l ON l.dataset = n.dataset AND l.row_id = n.row_id), "
        f"r AS (SELECT s.dataset, s.k, s.feature, CASE WHEN s.doit AND {new} IS NOT NULL THEN {new} ELSE s.value END AS x FROM s LEFT JOIN hh h ON s.dataset = h.dataset AND s.feature = h.feature AND s.u >= h.since AND s.u < h.upto {extra}) "
        "SELECT dataset, k, " + ", ".join(f"round(max(CASE WHEN feature = 'x{j}' THEN x END), 6) AS x{j}" for j in (1, 2, 3)) + " FROM r GROUP BY ALL"
    )


def _hist(spark, sf_dir, **how):
    return Y.histogram_draw(_normals(spark, sf_dir), _THREE, 200, 2, **how).select("dataset", "k", *[F.round(f, 6).alias(f) for f in _THREE])


@query(sql("tab", _hist_sql(1.0, 0.4, True)))
def y2_histogram_draw(spark, sf_dir):
    return _hist(spark, sf_dir)


@query(sql("tab", _hist_sql(-2.0, 0.7, False)))
def y5_y6_bin_interpolation_and_grid(spark, sf_dir):
    return _hist(spark, sf_dir, beta=-2.0, share=0.7, observed=False)


_GRID_CELLS = [(beta, share) for beta in (-4.0, -2.0, 2.0) for share in (0.4, 1.0)]


@query(sql("tab", " UNION ALL ".join(f"SELECT {b}::DOUBLE AS beta, {s}::DOUBLE AS share, * FROM ({_hist_sql(b, s, True)})" for b, s in _GRID_CELLS)))
def y6_histogram_grid(spark, sf_dir):
    """Every exponent with every share of features."""
    parts = [_hist(spark, sf_dir, beta=b, share=s).select(F.lit(b).alias("beta"), F.lit(s).alias("share"), "*") for b, s in _GRID_CELLS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query()
def y3_alpha_spectrum(spark, sf_dir):
    parts = [Y.alpha_spectrum(_normals(spark, sf_dir), _THREE, 50, 3, a).withColumn("alpha", F.lit(a)) for a in (0.0, 0.5, 1.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def y4_mixed_modes(spark, sf_dir):
    return Y.mixed_modes(_normals(spark, sf_dir), _THREE, 100, 4)


@query()
def y7_y8_y14_y15_y16_geometric(spark, sf_dir):
    n = _normals(spark, sf_dir)
    parts = [Y.geometric(n, _THREE, 40, 5, k).withColumn("kind", F.lit(k)) for k in ("between_centres", "density_band", "level_set", "void", "valley")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(sql("tab", f"WITH {_BASE}, c AS (SELECT dataset, row_id % 5 AS g, avg(x1 / 100) AS a, avg(x3 * 10) AS b FROM n GROUP BY ALL), d AS (SELECT n.dataset, n.row_id, round(sqrt(min((x1 / 100 - a) ** 2 + (x3 * 10 - b) ** 2)), 9) AS d FROM n JOIN c USING (dataset) GROUP BY ALL), q AS (SELECT dataset, quantile_cont(d, 0.6) AS q FROM d GROUP BY ALL), f AS (SELECT *, d > q AS far FROM d JOIN q USING (dataset)) SELECT dataset, row_id FROM f QUALIFY far OR sum(far::INT) OVER (PARTITION BY dataset) < 10"))
def y9_cluster_filter(spark, sf_dir):
    n = _normals(spark, sf_dir).selectExpr("dataset", "row_id", "x1 / 100 AS a", "x3 * 10 AS b")
    centres = n.groupBy("dataset", (F.col("row_id") % 5).alias("g")).agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    return Y.cluster_filter(n, n, centres, ("a", "b")).select("dataset", "row_id")


@query()
def y10_y12_single_feature_elevation(spark, sf_dir):
    n = _normals(spark, sf_dir)
    return Y.elevate(n, _THREE, 100, 6).withColumn("kind", F.lit("elevate")).unionByName(Y.marginal_probe(n, _THREE, 100, 6).withColumn("kind", F.lit("marginal")))


_PROBE = f"""WITH {_BASE}, f AS (SELECT dataset, row_id, unnest([{{'f': 0, 'v': x1}}, {{'f': 1, 'v': x2}}, {{'f': 2, 'v': x3}}]) AS u FROM n),
q AS (SELECT dataset, u.f AS f, quantile_cont(u.v, 0.05) AS lo, quantile_cont(u.v, 0.95) AS hi FROM f GROUP BY ALL),
t AS (SELECT f.dataset, f.u.f AS f, s, f.u.v AS v, row_number() OVER (PARTITION BY f.dataset, f.u.f, s ORDER BY f.u.v, row_id) - 1 AS i, count(*) OVER (PARTITION BY f.dataset, f.u.f, s) AS c
 FROM f JOIN q ON f.dataset = q.dataset AND f.u.f = q.f, (SELECT unnest([0, 1]) AS s) WHERE CASE WHEN s = 0 THEN f.u.v <= lo ELSE f.u.v >= hi END),
d AS (SELECT dataset, k, floor({_u(9, 'base')} * n)::BIGINT AS b, floor({_u(9, 'feature')} * 3)::INT AS f, CASE WHEN {_u(9, 'side')} < 0.5 THEN 1 ELSE 0 END AS s, {_u(9, 'value')} AS u FROM z, range(100) r(k))
SELECT d.dataset, k, CASE WHEN d.f = 0 THEN v ELSE x1 END AS x1, CASE WHEN d.f = 1 THEN v ELSE x2 END AS x2, CASE WHEN d.f = 2 THEN v ELSE x3 END AS x3
FROM d JOIN n ON n.dataset = d.dataset AND n.i = d.b JOIN t ON t.dataset = d.dataset AND t.f = d.f AND t.s = d.s AND t.i = floor(d.u * t.c)::BIGINT"""


@query(sql("tab", _PROBE))
def y12_marginal_probe(spark, sf_dir):
    return Y.marginal_probe(_normals(spark, sf_dir), _THREE, 100, 9)


@query()
def y12_dependency_probe(spark, sf_dir):
    return Y.dependency_probe(_normals(spark, sf_dir), FEATURES[:3], 100, 9)


_SHIFT = ", ".join(f"avg({f}) AS m{f}, stddev_pop({f}) AS s{f}, min({f}) AS l{f}, max({f}) AS h{f}" for f in ("x1", "x2", "x3"))
_SHIFTED = ", ".join(f"round(least(greatest({f} + CASE WHEN c{f} >= m{f} THEN 1 ELSE -1 END * 1.5 * s{f}, l{f}), h{f}), 6) AS {f}" for f in ("x1", "x2", "x3"))


@query(sql("tab", f"WITH s AS (SELECT dataset, {_SHIFT} FROM tab GROUP BY ALL), c AS (SELECT dataset, avg(x1) AS cx1, avg(x2) AS cx2, avg(x3) AS cx3 FROM tab WHERE row_id % 9 = 0 GROUP BY ALL) SELECT dataset, 1.5::DOUBLE AS delta, row_id, {_SHIFTED} FROM tab JOIN s USING (dataset) JOIN c USING (dataset) WHERE row_id % 9 = 0"))
def y11_cluster_shift(spark, sf_dir):
    """The rows of every ninth order stand for the held-out cluster."""
    t = base.tab(spark, sf_dir)
    s = Y.shift_cluster(t, t.where("row_id % 9 = 0").select("dataset", "row_id"), _THREE, 1.5)
    return s.select("dataset", "delta", "row_id", *[F.round(f, 6).alias(f) for f in _THREE])


@query(sql("tab", f"WITH {_BASE}, g AS (SELECT dataset, stddev_pop(x1) AS s FROM n GROUP BY ALL), d AS (SELECT dataset, k, floor({_u(7, 'base')} * n)::BIGINT AS b FROM z, range(100) t(k)) SELECT d.dataset, k, round(CASE WHEN {_u(7, 'hit:x1')} < 0.5 THEN x1 + CASE WHEN {_u(7, 'sign:x1')} < 0.5 THEN -1 ELSE 1 END * (4 + 4 * {_u(7, 'size:x1')}) * s ELSE x1 END, 6) AS x1 FROM d JOIN n ON d.dataset = n.dataset AND d.b = n.i JOIN g ON g.dataset = d.dataset"))
def y13_injection_spike(spark, sf_dir):
    return Y.inject(_normals(spark, sf_dir), ("x1",), 100, 7, "spike", 0.5).select("dataset", "k", F.round("x1", 6).alias("x1"))


@query()
def y13_injection_types(spark, sf_dir):
    n = _normals(spark, sf_dir)
    parts = [Y.inject(n, _THREE, 50, 8, k).withColumn("kind", F.lit(k)) for k in ("noise", "scale", "contextual", "cutoff")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(sql("tab", f"WITH {_BASE}, s AS (SELECT dataset, min(x1) AS l, max(x1) AS h, min(x2) AS l2, max(x2) AS h2 FROM n GROUP BY ALL) SELECT dataset, row_id, round(least(greatest(x1 * 1.5 + 0.25, l), h), 0) AS x1, round(least(greatest(x2 * 1.5, l2), h2), 6) AS x2 FROM n JOIN s USING (dataset)"))
def y17_validity_projection(spark, sf_dir):
    n = _normals(spark, sf_dir)
    moved = n.select("dataset", "row_id", (F.col("x1") * 1.5 + 0.25).alias("x1"), (F.col("x2") * 1.5).alias("x2"))
    return Y.project_valid(moved, n, ("x1", "x2")).select("dataset", "row_id", "x1", F.round("x2", 6).alias("x2"))


MARGINAL = ["COPOD", "ECOD", "HBOS_20", "MaxZ", "PCA_0.9"]


def _trained(spark, sf_dir, seed):
    """The normals, and the networks of those that no grading holds out."""
    n = stored(_normals(spark, sf_dir), "normals")
    return n, N.fit(n.where(~G.held_out(seed, 0.3)), FEATURES)


@query()
def y17_reconstruction_error(spark, sf_dir):
    """Every row's distance from what its data set's autoencoder, fitted on the normals, makes of it."""
    _, nets = _trained(spark, sf_dir, 17)
    e = N.reconstruction(base.tab(spark, sf_dir), FEATURES, nets)
    return e.select("dataset", "row_id", F.round("error", 3).alias("error"))


@query()
def y17_latent_bands_graded(spark, sf_dir):
    """Detectors on synthetic rows of three shares of exchanged features and three bands of latent distance."""
    n, nets = _trained(spark, sf_dir, 17)
    made = N.latent_bands(n.where(~G.held_out(17, 0.3)), FEATURES, nets, 60, 17)
    g = G.synthetic_quality(n, made, FEATURES, MARGINAL, ["share", "band"], 17, digits=5)
    return g.withColumn("auc", F.round("auc", 3))


@query()
def y17_off_manifold_ranking(spark, sf_dir):
    """The ranking of detectors by synthetic rows that the autoencoder renders badly, and by the same rows unfiltered, against
    the true one."""
    n, nets = _trained(spark, sf_dir, 17)
    train = n.where(~G.held_out(17, 0.3))
    c = stored(Y.shuffle_features(train, FEATURES, 400, 17, 1, multi=True), "candidates")
    arms = N.off_manifold(c, train, FEATURES, nets).drop("error").withColumn("arm", F.lit("filtered")).unionByName(c.withColumn("arm", F.lit("unfiltered")))
    first = arms.withColumn("_k", F.row_number().over(W.partitionBy("dataset", "arm").orderBy("k"))).where(F.col("_k") <= 120)
    g = G.synthetic_quality(n, first, FEATURES, MARGINAL, ["arm"], 17, digits=5).where("auc IS NOT NULL")
    both = stored(g.join(G.true_quality(base.tab(spark, sf_dir), FEATURES, MARGINAL, 3, 5), ["dataset", "detector"]).where("true_auc IS NOT NULL"), "both")
    rho = M.spearman(both, ["dataset", "arm"], "auc", "true_auc")
    return both.join(rho, ["dataset", "arm"], "left").select("dataset", "arm", "detector", "n_pos", *[F.round(x, 3).alias(x) for x in ("auc", "true_auc", "rho")])


# --- descriptions

_MOM = "m AS (SELECT dataset, feature, avg(value) AS m, stddev_pop(value) AS s FROM feat GROUP BY ALL), k AS (SELECT f.dataset, f.feature, avg(((value - m) / s) ** 3) AS s, avg(((value - m) / s) ** 4) - 3 AS k FROM feat f JOIN m ON f.dataset = m.dataset AND f.feature = m.feature GROUP BY ALL)"


_SHAPE = """SELECT dataset, round(avg(abs(s)), 6) AS mean_skew, round(avg(k), 6) AS mean_kurt, round(max(k), 6) AS kurt_max, avg(CASE WHEN k > 3 THEN 1.0 ELSE 0 END) AS heavy_share,
avg(CASE WHEN (s * s + 1) / (k + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))) > 0.555 THEN 1.0 ELSE 0 END) AS bimodal_share
FROM k JOIN (SELECT dataset, feature, count(*)::DOUBLE AS n FROM feat GROUP BY ALL) USING (dataset, feature) GROUP BY ALL"""


@query(sql("feat", f"WITH {_MOM} {_SHAPE}"))
def x1_x3_moments_and_bimodality(spark, sf_dir):
    m = X.moments(base.long(base.tab(spark, sf_dir)))
    return m.select("dataset", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


_EXTENT = """WITH s AS (SELECT dataset, avg(x1) AS a, stddev_pop(x1) AS p, avg(x2) AS b, stddev_pop(x2) AS q, avg(x3) AS c, stddev_pop(x3) AS u, avg(x4) AS d, stddev_pop(x4) AS v FROM tab GROUP BY ALL),
f AS (SELECT dataset, sqrt(((x1 - a) / p) ** 2 + ((x2 - b) / q) ** 2 + ((x3 - c) / u) ** 2 + ((x4 - d) / v) ** 2) AS f FROM tab JOIN s USING (dataset))
SELECT dataset, round(quantile_cont(f, 0.99) / (quantile_cont(f, 0.5) + 1e-9), 6) AS tail_ratio, round(log10(count(*)), 6) AS log_n, round(log10(4), 6) AS log_d FROM f GROUP BY ALL"""


@query(sql("tab", _EXTENT))
def x2_extent(spark, sf_dir):
    return X.extent(base.tab(spark, sf_dir), FEATURES).select("dataset", *[F.round(c, 6).alias(c) for c in ("tail_ratio", "log_n", "log_d")])


@query()
def x2_cluster_gain(spark, sf_dir):
    return X.extent(base.tab(spark, sf_dir), FEATURES).select("dataset", "cluster_gain")


@query()
def x1_x3_mixture_orders(spark, sf_dir):
    """Number of parts by BIC up to 8, void mass and likelihood gap, fitted on all rows."""
    return MX.orders(base.tab(spark, sf_dir), FEATURES)


@query(sql("tab", "SELECT dataset, round((" + " + ".join(f"abs(corr({a}, {b}))" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]) + ") / 6, 6) AS mean_abs_corr FROM tab GROUP BY ALL"))
def x1_mean_correlation(spark, sf_dir):
    return X.mean_correlation(base.tab(spark, sf_dir), FEATURES).withColumn("mean_abs_corr", F.round("mean_abs_corr", 6))


@query()
def x1_spectrum(spark, sf_dir):
    return X.spectrum(base.tab(spark, sf_dir), FEATURES)


_NN = """WITH s AS (SELECT dataset, avg(x1) AS a, stddev_pop(x1) AS p, avg(x2) AS c, stddev_pop(x2) AS u FROM tab GROUP BY ALL),
z AS (SELECT dataset, row_id, (x1 - a) / p AS x, (x2 - c) / u AS y FROM tab JOIN s USING (dataset)),
g AS (SELECT a.dataset, a.row_id, min({'d': sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 'o': b.row_id}, 5) AS l FROM z a JOIN z b ON a.dataset = b.dataset AND a.row_id <> b.row_id GROUP BY ALL),
e AS (SELECT dataset, row_id, l[1].d AS d1, l[2].d / (l[1].d + 1e-12) AS mu FROM g),
h AS (SELECT z.dataset, z.row_id, coalesce(c, 0) AS c FROM z LEFT JOIN (SELECT dataset, u.o AS row_id, count(*) AS c FROM (SELECT dataset, unnest(l) AS u FROM g) GROUP BY ALL) USING (dataset, row_id)),
k AS (SELECT dataset, avg(((c - m) / v) ** 3) AS hubness FROM h JOIN (SELECT dataset, avg(c) AS m, stddev_pop(c) AS v FROM h GROUP BY ALL) USING (dataset) GROUP BY ALL)
SELECT dataset, round(quantile_cont(d1, 0.5), 6) AS nn_scale, round(stddev_pop(d1) / (avg(d1) + 1e-9), 6) AS density_spread, round(quantile_cont(d1, 0.9) / (quantile_cont(d1, 0.1) + 1e-9), 6) AS nn_ratio,
round(count(*) FILTER (mu > 1) / (sum(ln(mu)) FILTER (mu > 1) + 1e-9), 4) AS two_nn_dim, round(any_value(hubness), 6) AS hubness FROM e JOIN k USING (dataset) GROUP BY ALL"""


@query(sql("tab", _NN))
def x1_x2_neighbour_structure(spark, sf_dir):
    s = X.neighbour_structure(base.tab(spark, sf_dir), ("x1", "x2"))
    return s.select("dataset", *[F.round(c, 6).alias(c) for c in ("nn_scale", "density_spread", "nn_ratio", "hubness")], F.round("two_nn_dim", 4).alias("two_nn_dim"))


@query(sql("tab", "WITH g AS (SELECT dataset, row_id, x1 / 100 AS p, x3 * 10 AS q, floor(x1 / 90)::INT AS c FROM tab), m AS (SELECT a.dataset, a.row_id, a.c, b.c AS o, avg(sqrt((a.p - b.p) ** 2 + (a.q - b.q) ** 2)) AS m FROM g a JOIN g b ON a.dataset = b.dataset AND a.row_id <> b.row_id AND a.row_id % 100 = 0 GROUP BY ALL), s AS (SELECT dataset, row_id, min(CASE WHEN c = o THEN m END) AS a, min(CASE WHEN c <> o THEN m END) AS b FROM m GROUP BY ALL) SELECT dataset, round(avg((b - a) / (greatest(a, b) + 1e-12)), 6) AS silhouette FROM s WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL"))
def x1_x4_silhouette(spark, sf_dir):
    g = base.tab(spark, sf_dir).selectExpr("dataset", "row_id", "x1 / 100 AS p", "x3 * 10 AS q", "int(floor(x1 / 90)) AS cluster")
    return X.silhouette(g.where("row_id % 100 = 0"), ("p", "q"), g).withColumn("silhouette", F.round("silhouette", 6))


@query()
def x3_dip(spark, sf_dir):
    """Dips of the features and of 60 random projections over all rows, with their p-values by uniform draws."""
    return MO.modality(base.tab(spark, sf_dir), FEATURES)


_D5 = "b AS (SELECT dataset, quantile_cont(x1, 0.01) AS l1, quantile_cont(x1, 0.99) AS h1, quantile_cont(x3, 0.01) AS l3, quantile_cont(x3, 0.99) AS h3 FROM tab WHERE y = 0 GROUP BY ALL), p AS (SELECT a.dataset, a.row_id, a.y, a.x1, a.x3, sqrt((a.x1 - b.x1) ** 2 + (a.x3 - b.x3) ** 2) AS d FROM asked a JOIN tab b ON a.dataset = b.dataset AND a.row_id <> b.row_id AND b.y = 0), n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY dataset, row_id ORDER BY d) <= 5), m AS (SELECT dataset, row_id, y, x1, x3, max(d) AS d FROM n GROUP BY ALL), c AS (SELECT dataset, quantile_cont(d, 0.95) AS c FROM m WHERE y = 0 GROUP BY ALL)"


@query(sql("asked", f"WITH {_D5} SELECT dataset, row_id, CASE WHEN x1 < l1 OR x1 > h1 OR x3 < l3 OR x3 > h3 THEN 'outside' WHEN d > c THEN 'inside_far' ELSE 'embedded' END AS place FROM m JOIN b USING (dataset) JOIN c USING (dataset) WHERE y = 1"))
def x5_void_placement(spark, sf_dir):
    return X.placement(base.tab(spark, sf_dir), ("x1", "x3"), asked=base.asked(spark, sf_dir))


@query()
def x6_x7_anomaly_geometry(spark, sf_dir):
    return X.anomaly_geometry(base.tab(spark, sf_dir), ("x1", "x3"), asked=base.asked(spark, sf_dir))


@query(sql("tab", "WITH s AS (SELECT dataset, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x3) AS m3, stddev_pop(x3) AS s3 FROM tab WHERE y = 0 GROUP BY ALL), z AS (SELECT dataset, ((x1 - m1) / (s1 + 1e-9)) ** 2 AS a, ((x3 - m3) / (s3 + 1e-9)) ** 2 AS b FROM tab JOIN s USING (dataset) WHERE y = 1) SELECT dataset, round(avg(greatest(a, b) / (a + b)), 6) AS top_share, round(avg((a + b) ** 2 / (a * a + b * b)), 6) AS effective_features FROM z GROUP BY ALL"))
def x8_signature(spark, sf_dir):
    t = base.tab(spark, sf_dir)
    return X.signature(t.where("y = 1"), t.where("y = 0"), ("x1", "x3")).select("dataset", F.round("top_share", 6).alias("top_share"), F.round("effective_features", 6).alias("effective_features"))


@query()
def x9_single_against_multivariate(spark, sf_dir):
    t = base.tab(spark, sf_dir)
    s = D.run_pool(t, FEATURES, GRADED).join(t.select("dataset", "row_id", "y"), ["dataset", "row_id"])
    return X.best_feature_against_best_detector(base.long(t), s)
