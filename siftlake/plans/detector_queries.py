"""Queries of embedding, neighbours, detectors and hardening."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.operators import boosting as B
from siftlake.operators import density as N
from siftlake.operators import detectors as D
from siftlake.operators import harden as H
from siftlake.operators import metrics as M
from siftlake.operators import pseudo as G
from siftlake.operators import separability as SP
from siftlake.operators import space as E
from siftlake.plans import base
from siftlake.plans.base import FEATURES, sql
from siftlake.plans.registry import query
from siftlake.session import stored

TWO = ("x1", "x3")


def _scores(df, digits=6):
    return df.select("dataset", "row_id", F.round("score", digits).alias("score"))


@query(sql("tab", "SELECT dataset, row_id, " + ", ".join(f"round((t.{f} - avg({f}) OVER w) / stddev_pop({f}) OVER w, 6) AS {f}" for f in FEATURES) + " FROM tab t WINDOW w AS (PARTITION BY dataset)"))
def e1_standardise(spark, sf_dir):
    return E.standardise(base.tab(spark, sf_dir), FEATURES).select("dataset", "row_id", *[F.round(f, 6).alias(f) for f in FEATURES])


def _vectors(spark, sf_dir):
    e = base.table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("e"), (F.col("label") % 2).cast("string")).alias("dataset"), F.col("vec_id").alias("row_id"), "label", *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(24)])


@query()
def e2_embed_principal(spark, sf_dir):
    return E.embed(_vectors(spark, sf_dir), tuple(f"v{i}" for i in range(24)), 16).select("dataset", "row_id", "z")


@query()
def e3_kmeans(spark, sf_dir):
    return E.kmeans(E.embed(base.tab(spark, sf_dir), FEATURES), 30).select("dataset", "row_id", "cluster")


_GRID = "SELECT dataset, row_id, x1 / 100 AS p, x3 * 10 AS q, (floor(x1 / 60) * 3 + floor(x3 * 30))::INT AS cluster FROM tab"


@query(sql("tab", f"WITH g AS ({_GRID}), c AS (SELECT dataset, cluster, count(*) AS size, avg(p) AS cp, avg(q) AS cq FROM g GROUP BY ALL), i AS (SELECT g.dataset, g.cluster, avg(sqrt((p - cp) ** 2 + (q - cq) ** 2)) AS den FROM g JOIN c USING (dataset, cluster) GROUP BY ALL), f AS (SELECT dataset, cluster, avg(d) AS far FROM (SELECT a.dataset, a.cluster, sqrt((a.cp - b.cp) ** 2 + (a.cq - b.cq) ** 2) AS d FROM c a JOIN c b ON a.dataset = b.dataset AND a.cluster <> b.cluster QUALIFY row_number() OVER (PARTITION BY a.dataset, a.cluster ORDER BY d, b.cluster) <= 3) GROUP BY ALL), s AS (SELECT dataset, cluster, size, 1 - size / sum(size) OVER (PARTITION BY dataset) AS s, coalesce(far, 0) AS far, den FROM c JOIN i USING (dataset, cluster) LEFT JOIN f USING (dataset, cluster)), n AS (SELECT dataset, cluster, size, (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) AS a, (far - min(far) OVER w) / (max(far) OVER w - min(far) OVER w) AS b, (den - min(den) OVER w) / (max(den) OVER w - min(den) OVER w) AS c FROM s WINDOW w AS (PARTITION BY dataset)) SELECT dataset, cluster, size, round(a, 6) AS size_component, round(b, 6) AS far_component, round(c, 6) AS density_component, round((a + b + c) / 3, 6) AS composite FROM n"))
def e4_composite_cluster_scores(spark, sf_dir):
    r = E.composite_scores(_grid(spark, sf_dir))
    return r.select("dataset", "cluster", "size", *[F.round(c, 6).alias(c) for c in ("size_component", "far_component", "density_component", "composite")])


def _grid(spark, sf_dir):
    return base.tab(spark, sf_dir).selectExpr("dataset", "row_id", "y", "array(x1 / 100, x3 * 10) AS z", "int(floor(x1 / 60) * 3 + floor(x3 * 30)) AS cluster")


@query()
def e5_gaussian_mixture(spark, sf_dir):
    return E.mixture(E.embed(base.tab(spark, sf_dir), FEATURES), 4).select("dataset", "row_id", "cluster")


@query(sql("tab", f"SELECT dataset, count(DISTINCT cluster) AS n_clusters, count(DISTINCT cluster) >= 3 AS use_mixture FROM ({_GRID}) GROUP BY ALL"))
def e6_effective_clusters(spark, sf_dir):
    return E.effective_clusters(_grid(spark, sf_dir))


_PAIRS = "p AS (SELECT a.dataset, a.row_id, b.row_id AS other, sqrt((a.x1 - b.x1) ** 2 + (a.x3 - b.x3) ** 2) AS d FROM asked a JOIN tab b ON a.dataset = b.dataset AND a.row_id <> b.row_id), n AS (SELECT *, row_number() OVER (PARTITION BY dataset, row_id ORDER BY d, other) AS k FROM p QUALIFY k <= {k})"


@query(sql("asked", f"WITH {_PAIRS.format(k=5)} SELECT dataset, row_id, k AS place, round(d, 6) AS distance FROM n"))
def e7_j9_nearest_neighbours(spark, sf_dir):
    return E.neighbours(base.asked(spark, sf_dir), base.tab(spark, sf_dir), TWO, 5).select("dataset", "row_id", "place", F.round("distance", 6).alias("distance"))


@query()
def e9_random_projection(spark, sf_dir):
    return E.random_projection(_vectors(spark, sf_dir), tuple(f"v{i}" for i in range(24)), 16).select("dataset", "row_id", "z")


_SEPARATION = f"""WITH g AS ({_GRID}), c AS (SELECT dataset, cluster, avg(p) AS cp, avg(q) AS cq, count(*) AS n, var_pop(p) + var_pop(q) AS v FROM g GROUP BY ALL),
a AS (SELECT dataset, avg(p) AS ap, avg(q) AS aq, count(*) AS n, count(DISTINCT cluster) AS k FROM g GROUP BY ALL),
r AS (SELECT c.dataset, (sum(c.n * ((cp - ap) ** 2 + (cq - aq) ** 2)) / (any_value(k) - 1)) / (sum(c.n * v) / (any_value(a.n) - any_value(k))) AS calinski FROM c JOIN a USING (dataset) GROUP BY ALL),
s AS (SELECT dataset, cluster, avg(sqrt((p - cp) ** 2 + (q - cq) ** 2)) AS s, any_value(cp) AS cp, any_value(cq) AS cq FROM g JOIN c USING (dataset, cluster) GROUP BY ALL),
w AS (SELECT x.dataset, x.cluster, max((x.s + y.s) / sqrt((x.cp - y.cp) ** 2 + (x.cq - y.cq) ** 2)) AS w FROM s x JOIN s y ON x.dataset = y.dataset AND x.cluster <> y.cluster GROUP BY ALL)
SELECT dataset, round(any_value(calinski), 6) AS calinski, round(-avg(w), 6) AS davies FROM w JOIN r USING (dataset) GROUP BY ALL"""


@query(sql("tab", _SEPARATION))
def e9_separation(spark, sf_dir):
    return E.separation(_grid(spark, sf_dir)).select("dataset", F.round("calinski", 6).alias("calinski"), F.round("davies", 6).alias("davies"))


@query()
def e9_kernel_latent(spark, sf_dir):
    """Separation of eight k-means clusters in the raw, principal and kernel latents."""
    rows = stored(base.tab(spark, sf_dir), "rows")
    z = E.standardise(rows, FEATURES)
    latents = {"raw": z.select("dataset", "row_id", F.array(*FEATURES).alias("z")), "pca2": E.embed(rows, FEATURES, 2).select("dataset", "row_id", "z"), "kernel": E.kernel_projection(rows, FEATURES)}
    parts = [E.separation(stored(E.kmeans(x, 8), "clusters")).withColumn("latent", F.lit(n)) for n, x in latents.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def e10_density_clusters(spark, sf_dir):
    """The lines of each supplier as a data set: the chosen smallest cluster size, with its clusters and share of noise."""
    lines = base.table(spark, sf_dir, "lineitem")
    names = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = lines.select(F.concat(F.lit("s"), "l_suppkey").alias("dataset"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), *[F.col(c).cast("double").alias(c) for c in names])
    return N.adaptive(E.standardise(rows, names), names)[0]


@query()
def m16_separability(spark, sf_dir):
    """Of six detectors of the pool, how far a kernel machine sets what they flag apart."""
    rows = stored(base.tab(spark, sf_dir), "rows")
    scores = D.fit_and_score(rows, rows, FEATURES, ["COPOD", "ECOD", "HBOS_20", "KNN_k10", "MaxZ", "PCA_0.5"])
    return SP.separability(scores, rows, FEATURES)


@query(sql("asked", f"WITH {_PAIRS.format(k=10)} SELECT dataset, row_id, round(max(d), 6) AS score FROM n GROUP BY ALL"))
def k1_knn(spark, sf_dir):
    return _scores(D.knn(base.asked(spark, sf_dir), TWO, 10, base.tab(spark, sf_dir)))


_LOF = """WITH p AS (SELECT a.dataset, a.row_id, min({'d': sqrt((a.x1 - b.x1) ** 2 + (a.x3 - b.x3) ** 2), 'o': b.row_id}, 20) AS near
  FROM tab a JOIN tab b ON a.dataset = b.dataset AND a.row_id <> b.row_id GROUP BY ALL),
n AS (SELECT dataset, row_id, u.d AS d, u.o AS o FROM (SELECT dataset, row_id, unnest(near) AS u FROM p)),
r AS (SELECT dataset, row_id AS o, max(d) AS r FROM n GROUP BY ALL),
l AS (SELECT n.dataset, n.row_id, 1 / nullif(avg(greatest(d, r)), 0) AS lrd FROM n JOIN r USING (dataset, o) GROUP BY ALL),
m AS (SELECT n.dataset, n.row_id, avg(l.lrd) AS m FROM n JOIN l ON n.dataset = l.dataset AND n.o = l.row_id GROUP BY ALL)
SELECT dataset, row_id, round(m / nullif(lrd, 0), 6) AS score FROM m JOIN l USING (dataset, row_id) WHERE row_id % 100 = 0"""


@query(sql("tab", _LOF))
def k2_lof(spark, sf_dir):
    """Fitted on all rows, scored on the asked rows among them."""
    t = base.tab(spark, sf_dir)
    return _scores(D.lof(t, TWO, 20).where("row_id % 100 = 0"))


_BINS = "b AS (SELECT *, CASE WHEN hi = lo THEN 1 ELSE least(greatest(floor((value - lo) / (hi - lo) * {n})::INT + 1, 1), {n}) END AS bin FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi, count(*) OVER w AS n FROM feat WINDOW w AS (PARTITION BY dataset, feature))), h AS (SELECT *, count(*) OVER (PARTITION BY dataset, feature, bin) / n * {n} AS density FROM b)"


@query(sql("feat", f"WITH {_BINS.format(n=20)} SELECT dataset, row_id, round(sum(-ln(density + 1e-6)), 5) AS score FROM h WHERE feature IN ('x1', 'x3') GROUP BY ALL"))
def k3_hbos(spark, sf_dir):
    return _scores(D.hbos(base.tab(spark, sf_dir), TWO, 20), 5)


_TAIL = "t AS (SELECT *, -ln(cume_dist() OVER (PARTITION BY dataset, feature ORDER BY value)) AS l, -ln(cume_dist() OVER (PARTITION BY dataset, feature ORDER BY value DESC)) AS r FROM feat), m AS (SELECT dataset, feature, avg(value) AS m, stddev_pop(value) AS s FROM feat GROUP BY ALL), k AS (SELECT dataset, feature, avg(((value - m) / s) ** 3) AS skew FROM feat JOIN m USING (dataset, feature) GROUP BY ALL)"


@query(sql("feat", f"WITH {_TAIL} SELECT dataset, row_id, round(greatest(sum(l), sum(r), sum(CASE WHEN skew < 0 THEN l ELSE r END)), 5) AS score FROM t JOIN k USING (dataset, feature) WHERE feature IN ('x1', 'x2') GROUP BY ALL"))
def k4_ecod(spark, sf_dir):
    return _scores(D.ecod(base.tab(spark, sf_dir), ("x1", "x2")), 5)


@query(sql("feat", f"WITH {_TAIL} SELECT dataset, row_id, round(sum(greatest((l + r) / 2, CASE WHEN skew < 0 THEN l WHEN skew > 0 THEN r ELSE l + r END)), 5) AS score FROM t JOIN k USING (dataset, feature) WHERE feature IN ('x1', 'x2') GROUP BY ALL"))
def k5_copod(spark, sf_dir):
    return _scores(D.copod(base.tab(spark, sf_dir), ("x1", "x2")), 5)


@query()
def k6_pca(spark, sf_dir):
    return D.pca(base.tab(spark, sf_dir), FEATURES, 0.5)


@query()
def k7_cblof(spark, sf_dir):
    return D.cblof(base.tab(spark, sf_dir), FEATURES, 8)


@query()
def k8_loda(spark, sf_dir):
    return D.loda(base.tab(spark, sf_dir), FEATURES, 10)


@query()
def k9_iforest(spark, sf_dir):
    return D.iforest(base.tab(spark, sf_dir), FEATURES)


@query()
def k14_pool_scores(spark, sf_dir):
    """The whole pool, each variant fitted on all normal rows and graded by AUC on the asked rows."""
    rows = stored(base.tab(spark, sf_dir), "rows")
    t = rows.where("row_id % 100 = 0")
    s = D.fit_and_score(rows.where("y = 0"), t, FEATURES)
    return M.roc_auc(s.join(t.select("dataset", "row_id", "y"), ["dataset", "row_id"]), ["dataset", "detector"])


@query(sql("zfeat", "SELECT dataset, row_id, round(max(abs(z)), 6) AS score FROM zfeat GROUP BY ALL"))
def k15_h1_max_z(spark, sf_dir):
    return _scores(D.max_z(base.tab(spark, sf_dir), FEATURES))


@query(sql("feat", f"WITH {_BINS.format(n=20)}, s AS (SELECT dataset, row_id, y, round(sum(-ln(density + 1e-6)), 5) AS score FROM h GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0 AS k FROM s) SELECT dataset, round((sum(CASE WHEN y = 1 THEN k END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * sum(1 - y)), 6) AS auc FROM r GROUP BY ALL"))
def k15_h10_histogram_rule_auc(spark, sf_dir):
    t = base.tab(spark, sf_dir)
    s = D.hbos(t, FEATURES, 20).withColumn("score", F.round("score", 5)).join(t.select("dataset", "row_id", "y"), ["dataset", "row_id"])
    return M.roc_auc(s, ["dataset"]).select("dataset", F.round("auc", 6).alias("auc"))


_RES = "m AS (SELECT dataset, avg(x1) AS m1, avg(x3) AS m3, covar_pop(x1, x3) * count(*) AS s13, var_pop(x1) * count(*) AS s11, var_pop(x3) * count(*) AS s33 FROM tab WHERE y = 0 GROUP BY ALL), r AS (SELECT dataset, row_id, y, (x1 - m1) - s13 / (s33 + 1) * (x3 - m3) AS r1, (x3 - m3) - s13 / (s11 + 1) * (x1 - m1) AS r3 FROM tab JOIN m USING (dataset)), s AS (SELECT dataset, stddev_pop(r1) AS s1, stddev_pop(r3) AS s3 FROM r WHERE y = 0 GROUP BY ALL), l AS (SELECT dataset, row_id, y, greatest(abs(r1) / (s1 + 1e-9), abs(r3) / (s3 + 1e-9)) AS score FROM r JOIN s USING (dataset))"


@query(sql("tab", f"WITH {_RES} SELECT dataset, row_id, round(score, 5) AS score FROM l"))
def k15_h2_linear_residual(spark, sf_dir):
    t = base.tab(spark, sf_dir)
    return _scores(D.linear_residual(t, TWO, train=t.where("y = 0")), 5)


_Z = "SELECT dataset, row_id, coalesce((score - avg(score) OVER w) / nullif(stddev_pop(score) OVER w, 0), 0) AS z FROM point WINDOW w AS (PARTITION BY dataset, detector)"


@query(sql("point", f"SELECT dataset, row_id, round(avg(z), 6) AS score, round(max(z), 6) AS largest FROM ({_Z}) GROUP BY ALL"))
def k16_k17_ensembles_and_consensus(spark, sf_dir):
    p = base.point(spark, sf_dir)
    return _scores(D.ensemble(p)).join(D.ensemble(p, "max").select("dataset", "row_id", F.round("score", 6).alias("largest")), ["dataset", "row_id"])


@query()
def k18_supervised_learners(spark, sf_dir):
    t = base.tab(spark, sf_dir)
    train, test = t.where("row_id % 4 <> 0"), t.where("row_id % 4 = 0")
    parts = [D.supervised(train, test, FEATURES, k).select("dataset", F.lit(k).alias("detector"), "row_id", "score") for k in ("logistic", "forest")]
    return parts[0].unionAll(parts[1])


@query()
def k18_few_label_boosting(spark, sf_dir):
    """Boosted trees on the features and four detectors' scores, with 5 or 50 labelled anomalies in three draws each: AUC on the
    rows without labels."""
    rows = stored(base.tab(spark, sf_dir), "rows")
    roles = stored(G.true_roles(rows, 3), "roles")
    normal = rows.join(roles.where("role = 'train'").select("dataset", "row_id"), ["dataset", "row_id"])
    names = ["ECOD", "HBOS_20", "MaxZ", "PCA_0.5"]
    scores = D.run_pool(rows, FEATURES, names, normal).groupBy("dataset", "row_id").pivot("detector", names).agg(F.first("score"))
    wide = rows.join(scores.withColumnsRenamed({n: n.replace(".", "_") for n in names}), ["dataset", "row_id"]).drop("y")
    drawn = [B.few_labels(rows, roles, k, 3, k).withColumn("k", F.lit(k)) for k in (5, 50)]
    units = drawn[0].unionByName(drawn[1]).join(wide, ["dataset", "row_id"])
    s = B.boosted(units, (*FEATURES, *[n.replace(".", "_") for n in names]), ["dataset", "k", "draw"], rounds=10)
    return M.roc_auc(s.withColumn("score", F.round("score", 9)), ["dataset", "k", "draw"])


@query(sql("asked", "SELECT a.dataset, a.row_id, round(-min(sqrt((a.x1 - b.x1) ** 2 + (a.x3 - b.x3) ** 2)), 6) AS score FROM asked a JOIN tab b ON a.dataset = b.dataset AND b.y = 1 AND a.row_id <> b.row_id GROUP BY ALL"))
def k18_nearest_labelled(spark, sf_dir):
    return _scores(D.nearest_labelled(base.asked(spark, sf_dir), base.tab(spark, sf_dir), TWO))


# --- hardening

_MZ = "SELECT dataset, row_id, y, max(abs((value - m) / (s + 1e-9))) AS score FROM feat JOIN (SELECT dataset, feature, avg(value) AS m, stddev_pop(value) AS s FROM feat WHERE y = 0 GROUP BY ALL) USING (dataset, feature) GROUP BY ALL"


@query(sql("feat", f"WITH s AS ({_MZ}), q AS (SELECT dataset, quantile_cont(score, 0.95) AS q FROM s WHERE y = 0 GROUP BY ALL) SELECT dataset, row_id, y FROM s JOIN q USING (dataset) WHERE y = 0 OR score <= q"))
def h1_within_normal_range(spark, sf_dir):
    t = base.tab(spark, sf_dir)
    return H.within_normals(t, [D.max_z(t, FEATURES, True)], 0.95).select("dataset", "row_id", "y")


_MZ2 = _MZ.replace("FROM feat JOIN", "FROM (SELECT * FROM feat WHERE feature IN ('x1', 'x3')) JOIN")


@query(sql("feat", f"WITH {_RES}, z AS ({_MZ2}), q AS (SELECT l.dataset, quantile_cont(l.score, 0.99) AS a, quantile_cont(z.score, 0.99) AS b FROM l JOIN z USING (dataset, row_id) WHERE l.y = 0 GROUP BY ALL) SELECT dataset, l.row_id, l.y FROM l JOIN z USING (dataset, row_id) JOIN q USING (dataset) WHERE l.y = 0 OR (l.score <= a AND z.score <= b)"))
def h3_double_hard(spark, sf_dir):
    return H.double_hard(base.tab(spark, sf_dir), TWO).select("dataset", "row_id", "y")


_SWEEP = f"""WITH {_RES}, z AS ({_MZ2}), sw AS (SELECT l.dataset, l.y, l.score AS a, z.score AS b, level FROM l JOIN z USING (dataset, row_id), (SELECT unnest([0.9, 0.95, 0.99, 0.999])::DOUBLE AS level)),
q AS (SELECT dataset, quantile_cont(a, [0.9, 0.95, 0.99, 0.999]) AS qa, quantile_cont(b, [0.9, 0.95, 0.99, 0.999]) AS qb FROM sw WHERE y = 0 AND level = 0.9 GROUP BY ALL),
h AS (SELECT dataset, level, a <= qa[list_position([0.9, 0.95, 0.99, 0.999], level)] AND b <= qb[list_position([0.9, 0.95, 0.99, 0.999], level)] AS hard FROM sw JOIN q USING (dataset) WHERE y = 1)
SELECT dataset, level, count(*) FILTER (hard) AS kept, round(avg(hard::INT), 6) AS share FROM h GROUP BY ALL"""


@query(sql("feat", _SWEEP))
def h3_level_sweep(spark, sf_dir):
    t = base.tab(spark, sf_dir)
    normal = t.where("y = 0")
    rules = [D.max_z(t, TWO, train=normal), D.linear_residual(t, TWO, train=normal)]
    return H.level_sweep(t, rules, (0.9, 0.95, 0.99, 0.999)).withColumn("share", F.round("share", 6))


_SEV = "n AS (SELECT dataset, feature, count(*) AS m, min(value) AS lo, max(value) AS hi FROM feat WHERE y = 0 GROUP BY ALL HAVING max(value) - min(value) >= 1e-12), c AS (SELECT f.dataset, f.feature, f.row_id, f.y, f.value, m, lo, hi, sum(1 - f.y) OVER (PARTITION BY f.dataset, f.feature ORDER BY f.value RANGE UNBOUNDED PRECEDING) / m AS fb, least(greatest(floor((f.value - lo) / (hi - lo) * 30)::INT + 1, 1), 30) AS bin FROM feat f JOIN n USING (dataset, feature)), d AS (SELECT *, sum(1 - y) OVER (PARTITION BY dataset, feature, bin) / m AS density FROM c), v AS (SELECT dataset, row_id, y, max(greatest(-ln(greatest(2 * least(fb, 1 - fb), 1 / (2.0 * m))), -ln(density + 1e-9))) AS score FROM d GROUP BY ALL)"


@query(sql("feat", f"WITH {_SEV} SELECT dataset, row_id, round(score, 5) AS score FROM v"))
def h4_j8_severity(spark, sf_dir):
    return _scores(H.severity(base.tab(spark, sf_dir), FEATURES, splits=8), 5)


@query()
def h5_two_stage_hardening(spark, sf_dir):
    return H.two_stage(base.tab(spark, sf_dir), FEATURES).select("dataset", "row_id", "y")


_STAGES = [("range series", "p > 0.3"), ("not trivial", "t < 0.52"), ("normals", "n >= 150"), ("effective", "a >= 200")]


@query(sql("grade", "WITH i AS (SELECT 's' || l_suppkey AS dataset, avg(l_discount) * 10 AS p, avg(l_tax) * 12 AS t, count(*)::INT AS n, count(DISTINCT l_partkey) AS a FROM lineitem GROUP BY ALL) " + " UNION ALL ".join(f"SELECT {k} AS stage, '{name}' AS name, sum(CASE WHEN {' AND '.join('(' + c + ')' for _, c in _STAGES[: k + 1])} THEN 1 ELSE 0 END) AS left FROM i" for k, (name, _) in enumerate(_STAGES))))
def h6_construction_funnel(spark, sf_dir):
    g = base.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.avg("l_discount") * 10).alias("p"), (F.avg("l_tax") * 12).alias("t"), F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("a"))
    return H.funnel(g, _STAGES)


@query(sql("grade", "SELECT dataset, count(truth) AS n_variants, round(max(truth), 6) AS gt_best, round(max(truth) - avg(truth), 9) AS spread, max(a1) > 0.55 AS rule_trivial, string_agg(detector, '|' ORDER BY truth DESC, detector) AS gt_ranking, max(truth) >= 0.1 AND max(truth) - avg(truth) >= 0.03 AND max(a4) <= 0.9 AND NOT max(a1) > 0.55 AND count(truth) >= 5 AS include FROM grade GROUP BY ALL"))
def h7_d15_manifest(spark, sf_dir):
    m = H.manifest(base.grade(spark, sf_dir), "truth", "a4", "a1", 0.1, 0.03, 0.9, 0.55)
    return m.select("dataset", "n_variants", F.round("gt_best", 6).alias("gt_best"), F.round("spread", 9).alias("spread"), "rule_trivial", "gt_ranking", "include")


@query(sql("grade", "WITH g AS (SELECT dataset, max(truth) AS oracle, max(truth) - avg(truth) AS random, count(*) AS n FROM grade GROUP BY ALL) SELECT dataset FROM g WHERE oracle > 0.05 AND random > 0.02 AND n >= 7"))
def h8_score_floors(spark, sf_dir):
    g = base.grade(spark, sf_dir).groupBy("dataset").agg(F.max("truth").alias("oracle"), (F.max("truth") - F.avg("truth")).alias("random"), F.count(F.lit(1)).alias("n"))
    return g.where("oracle > 0.05 AND random > 0.02 AND n >= 7").select("dataset")


@query(sql("feat", f"WITH {_SEV}, z AS ({_MZ}), q AS (SELECT v.dataset, quantile_cont(v.score, 0.95) AS a, quantile_cont(z.score, 0.95) AS b FROM v JOIN z USING (dataset, row_id) WHERE v.y = 0 GROUP BY ALL) SELECT dataset, v.row_id, v.score > a OR z.score > b AS trivial FROM v JOIN z USING (dataset, row_id) JOIN q USING (dataset) WHERE v.y = 1"))
def h9_or_rule(spark, sf_dir):
    t = base.tab(spark, sf_dir)
    kept = H.within_normals(t, [H.severity(t, FEATURES), D.max_z(t, FEATURES, True)], 0.95).where("y = 1").select("dataset", "row_id", F.lit(False).alias("_t"))
    return t.where("y = 1").join(kept, ["dataset", "row_id"], "left").select("dataset", "row_id", F.coalesce("_t", F.lit(True)).alias("trivial"))


_REASONS = [("few_rows", "n < 3"), ("flat", "sd < 0.02"), ("easy", "m > 0.51")]


@query(sql("fact", "WITH i AS (SELECT corpus, dataset, detector, count(*) AS n, coalesce(stddev_pop(truth), 0) AS sd, avg(a1) AS m FROM fact GROUP BY ALL) SELECT corpus, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _REASONS) + " ELSE 'kept' END AS fate, count(*) AS n FROM i GROUP BY ALL"))
def h11_h12_drop_reasons_and_ledger(spark, sf_dir):
    i = base.fact(spark, sf_dir).groupBy("corpus", "dataset", "detector").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_pop("truth"), F.lit(0.0)).alias("sd"), F.avg("a1").alias("m"))
    return H.drop_reasons(i, "corpus", _REASONS)
