"""Queries of row cleaning, de-duplication, splits and windows."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from siftlake.functions.ranks import draw_order, uniform
from siftlake.operators import dedup as U
from siftlake.operators import rows as R
from siftlake.operators import windows as S
from siftlake.plans import base
from siftlake.plans.base import FEATURES, sql
from siftlake.plans.registry import query


@query(sql("tab", "SELECT dataset, row_id, round(x1 / 10, 6) AS x1, 'tabular' AS modality FROM tab WHERE x1 BETWEEN 50 AND 200 AND dataset IN ('d0', 'd2')"))
def f1_f2_projection_and_filter(spark, sf_dir):
    return base.tab(spark, sf_dir).where("x1 BETWEEN 50 AND 200 AND dataset IN ('d0', 'd2')").select("dataset", "row_id", F.round(F.col("x1") / 10, 6).alias("x1"), F.lit("tabular").alias("modality"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN 0 WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars::DOUBLE END, 0) AS cleaned FROM documents WHERE lang IS NOT NULL")
def f3_f4_missing_and_not_finite(spark, sf_dir):
    d = base.table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    v = F.expr("CASE WHEN doc_id % 5 = 0 THEN double('NaN') WHEN doc_id % 7 = 0 THEN double('Infinity') ELSE double(n_chars) END")
    return d.select("doc_id", R.finite_or_zero(v).alias("cleaned"))


@query(sql("point", "WITH s AS (SELECT dataset, detector, row_id, CASE WHEN detector = 'x2' AND dataset = 'd1' THEN 0.5 ELSE score END AS score FROM point) SELECT dataset, detector, count(*) AS n FROM s GROUP BY ALL HAVING stddev_pop(score) >= 1e-12 AND NOT (dataset = 'd0' AND detector = 'x3')"))
def f5_degenerate_scores(spark, sf_dir):
    s = base.point(spark, sf_dir).withColumn("score", F.expr("CASE WHEN detector = 'x2' AND dataset = 'd1' THEN 0.5D WHEN detector = 'x3' AND dataset = 'd0' AND row_id % 100 = 0 THEN double('NaN') ELSE score END"))
    return R.drop_degenerate(s, ["dataset", "detector"]).groupBy("dataset", "detector").agg(F.count(F.lit(1)).alias("n"))


@query(sql("tab", "SELECT dataset, row_id FROM tab JOIN (SELECT dataset FROM tab GROUP BY ALL HAVING count(*) >= 100 AND sum(y) >= 5 AND count(*) - sum(y) >= 50) USING (dataset)"))
def f6_size_gates(spark, sf_dir):
    return R.size_gates(base.tab(spark, sf_dir), ["dataset"], 100, 5, 50).select("dataset", "row_id")


@query(sql("tab", "SELECT dataset, row_id FROM tab QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5('3:' || row_id)) <= 500"))
def f7_row_cap(spark, sf_dir):
    return R.cap_rows(base.tab(spark, sf_dir), ["dataset"], 500, 3, "row_id").select("dataset", "row_id")


@query(sql("series", "WITH s AS (SELECT series, min(CASE WHEN label = 1 THEN pos END) AS a, max(CASE WHEN label = 1 THEN pos END) AS b, count(*) AS n FROM series GROUP BY ALL), f AS (SELECT series, greatest(0, least(coalesce(floor((a + b) / 2), floor(n / 2)) - 250, n - 500)) AS f FROM s) SELECT series, pos, value FROM series JOIN f USING (series) WHERE pos >= f AND pos < f + 500"))
def f8_centred_truncation(spark, sf_dir):
    return R.centred_truncation(base.series(spark, sf_dir), 500).select("series", "pos", "value")


@query(sql("feat", "SELECT dataset, feature, row_number() OVER (PARTITION BY dataset ORDER BY sd DESC, feature) AS place FROM (SELECT dataset, feature, stddev_pop(value) AS sd FROM feat GROUP BY ALL) QUALIFY place <= 2"))
def f9_channel_selection(spark, sf_dir):
    return R.top_channels(base.long(base.tab(spark, sf_dir)), ["dataset"], "feature", "value", 2)


_NAMED = "CASE p_partkey % 5 WHEN 0 THEN '.npz' WHEN 1 THEN '.csv' WHEN 2 THEN '.txt' WHEN 3 THEN '.tar' ELSE '' END"


@query(rf"SELECT p_partkey, replace(replace(lower(regexp_replace(regexp_replace(n, '\.(npz|csv|txt)$', ''), '^[0-9]+_', '')), '_', ''), '-', '') AS name FROM (SELECT p_partkey, p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '' END || replace(p_name, ' ', '-') || {_NAMED} AS n FROM part)")
def f10_name_normalisation(spark, sf_dir):
    name = F.expr(f"concat(p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '' END, replace(p_name, ' ', '-'), {_NAMED})")
    return base.table(spark, sf_dir, "part").select("p_partkey", R.normal_name(name).alias("name"))


@query(r"WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'https://github.com/own' || c_nationkey || '/r' || (c_custkey % 7) || '/x.csv' END AS link, CASE WHEN c_custkey % 3 = 1 THEN 't' || c_nationkey || '_part' || c_custkey END AS t FROM customer) SELECT c_custkey, CASE WHEN link IS NOT NULL THEN 'gh:' || regexp_extract(link, 'github\.com/([^/]+/[^/]+)', 1) WHEN t IS NOT NULL THEN 'tl:' || regexp_replace(t, '_part.*$', '') ELSE 'nm:' || regexp_replace(lower(c_name), '[0-9_]+$', '') END AS family FROM c JOIN customer USING (c_custkey)")
def f11_source_family(spark, sf_dir):
    c = base.table(spark, sf_dir, "customer")
    link = F.expr("CASE WHEN c_custkey % 3 = 0 THEN concat('https://github.com/own', c_nationkey, '/r', c_custkey % 7, '/x.csv') END")
    origin = F.expr("CASE WHEN c_custkey % 3 = 1 THEN concat('t', c_nationkey, '_part', c_custkey) END")
    return c.select("c_custkey", R.source_family(link, origin, F.col("c_name")).alias("family"))


_POOL = "LOF_k10 KNN_k5 CBLOF_4 HBOS_20 COPOD ECOD PCA_0.5 IForest_100 LODA_10 DeepSVDD".split()


@query("SELECT v AS variant, CASE WHEN regexp_matches(v, '^(LOF|KNN|CBLOF)') THEN 'local' WHEN regexp_matches(v, '^(HBOS|COPOD|ECOD|PCA)') THEN 'global' ELSE 'other' END AS family, CASE WHEN regexp_matches(v, '^(LOF|KNN|CBLOF)') THEN 'neighbor' WHEN regexp_matches(v, '^(HBOS|COPOD|ECOD)') THEN 'distribution' WHEN regexp_matches(v, '^(PCA|LODA|LinRes)') THEN 'projection' WHEN regexp_matches(v, '^IForest') THEN 'isolation' ELSE 'deep' END AS kind FROM (SELECT unnest([" + ", ".join(f"'{v}'" for v in _POOL) + "]) AS v)")
def f12_detector_family(spark, sf_dir):
    return spark.createDataFrame([(v,) for v in _POOL], "variant string").select("variant", R.detector_family(F.col("variant")).alias("family"), R.detector_kind(F.col("variant")).alias("kind"))


@query("SELECT o_orderkey, split_part(k, '__', 1) || '__' || split_part(k, '__', 2) AS parent FROM (SELECT o_orderkey, o_orderstatus || '__' || (o_custkey % 10) || '__' || o_orderkey AS k FROM orders)")
def f13_parent_key(spark, sf_dir):
    return base.table(spark, sf_dir, "orders").select("o_orderkey", R.parent_key(F.expr("concat_ws('__', o_orderstatus, o_custkey % 10, o_orderkey)")).alias("parent"))


@query(sql("tab", "WITH t AS (SELECT dataset, row_id, CASE WHEN x1 > 100 THEN 1 ELSE 0 END AS y FROM tab), c AS (SELECT *, floor(sum(1 - y) OVER (PARTITION BY dataset) * 0.25 / 0.75) AS c, row_number() OVER (PARTITION BY dataset, y ORDER BY md5('5:' || row_id)) AS n FROM t) SELECT dataset, row_id, y FROM c WHERE y = 0 OR n <= c"))
def f14_base_rate_cap(spark, sf_dir):
    t = base.tab(spark, sf_dir).withColumn("y", F.expr("CASE WHEN x1 > 100 THEN 1 ELSE 0 END"))
    return R.cap_base_rate(t, ["dataset"], 0.25, 5, "row_id").select("dataset", "row_id", "y")


_SEG = "SELECT series, min(pos) AS first, max(pos) AS last, count(*) AS length FROM (SELECT series, pos, pos - row_number() OVER (PARTITION BY series ORDER BY pos) AS g FROM series WHERE label = 1) GROUP BY series, g"


@query(sql("series", f"SELECT series, round(sum(CASE WHEN length >= 2 THEN length ELSE 0 END) / sum(length), 6) AS share FROM ({_SEG}) GROUP BY ALL HAVING sum(CASE WHEN length >= 2 THEN length ELSE 0 END) / sum(length) >= 0.01"))
def f15_point_anomaly_series(spark, sf_dir):
    return R.range_series(base.series(spark, sf_dir), 2, 0.01).select("series", F.round("share", 6).alias("share"))


@query(sql("series", _SEG))
def f15_segments(spark, sf_dir):
    return R.segments(base.series(spark, sf_dir))


@query(sql("series", "SELECT series, pos, p AS purity FROM (SELECT series, pos, avg(label) OVER w AS p, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING)) WHERE pos % 16 = 0 AND n = 64"))
def f16_window_purity(spark, sf_dir):
    return R.window_purity(base.series(spark, sf_dir))


# --- de-duplication and splits

_COARSE = "SELECT dataset, row_id, floor(x1 / 20) AS x1, floor(x2 / 20000) AS x2, y FROM tab"


def _coarse(spark, sf_dir):
    return base.tab(spark, sf_dir).selectExpr("dataset", "row_id", "double(floor(x1 / 20)) AS x1", "double(floor(x2 / 20000)) AS x2", "y")


@query(sql("tab", f"SELECT dataset, x1, x2, min(y) AS y, min(row_id) AS row_id FROM ({_COARSE}) GROUP BY dataset, x1, x2 HAVING min(y) = max(y)"))
def u1_mixed_label_duplicates(spark, sf_dir):
    return U.drop_mixed(_coarse(spark, sf_dir), ("x1", "x2"))


@query(sql("tab", "WITH c AS (SELECT dataset, row_id, floor(x1 / 4) AS x1, floor(x2 / 1000) AS x2, y FROM tab), k AS (SELECT *, x1::DECIMAL(30,6)::VARCHAR || '|' || x2::DECIMAL(30,6)::VARCHAR AS key FROM c) SELECT dataset, key, min(row_id) AS row_id FROM k a WHERE y = 1 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.y = 0 AND a.dataset = b.dataset AND a.key = b.key) GROUP BY ALL"))
def u2_u3_u4_distinct_new_anomalies(spark, sf_dir):
    fine = base.tab(spark, sf_dir).selectExpr("dataset", "row_id", "double(floor(x1 / 4)) AS x1", "double(floor(x2 / 1000)) AS x2", "y")
    k = fine.withColumn("key", U.key32(("x1", "x2")))
    return U.anomalies_unlike_normals(k).select("dataset", "key", "row_id")


@query(sql("tab", "WITH p AS (SELECT dataset, row_id, y, percent_rank() OVER (PARTITION BY dataset, y ORDER BY md5('9:' || row_id)) AS p FROM tab) SELECT dataset, row_id, CASE WHEN y = 1 THEN 'test' WHEN p < 0.6 THEN 'train' WHEN p < 0.8 THEN 'val' ELSE 'test' END AS split FROM p"))
def u5_three_way_split(spark, sf_dir):
    return U.three_way_split(base.tab(spark, sf_dir), 9).select("dataset", "row_id", "split")


@query(sql("tab", f"WITH k AS (SELECT dataset, x1::BIGINT || '|' || x2::BIGINT AS key, count(*) AS n FROM ({_COARSE}) GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY dataset ORDER BY md5('4:' || key) ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER (PARTITION BY dataset) AS t FROM k) SELECT dataset, key, CASE WHEN c <= 0.6 * t THEN 'train' WHEN c <= 0.8 * t THEN 'val' ELSE 'test' END AS split FROM c"))
def u6_grouped_split(spark, sf_dir):
    k = _coarse(spark, sf_dir).withColumn("key", F.expr("concat(bigint(x1), '|', bigint(x2))"))
    return U.grouped_split(k, "key", 4)


_WIN = "SELECT series, pos // 16 AS idx, pos // 16 AS pos, label AS y FROM (SELECT series, pos, max(label) OVER w AS label, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING)) WHERE pos % 16 = 0 AND n = 64"


def _split_sql(shares: tuple[int, ...], names: tuple[str, ...]) -> str:
    bounds, total = [sum(shares[: k + 1]) for k in range(len(shares))], sum(shares)
    case = "CASE WHEN y = 1 THEN 'test' " + " ".join(f"WHEN k <= {b} THEN '{n}'" for n, b in zip(names[:-1], bounds, strict=False)) + " ELSE 'test' END"
    touch = " OR ".join(f"(a.split = '{n}' AND b.split IN ({', '.join(repr(m) for m in names[i + 1 :])}))" for i, n in enumerate(names[:-1]))
    return f"WITH w AS ({_WIN}), b AS (SELECT *, floor(idx * {total} / count(*) OVER (PARTITION BY series))::INT AS block FROM w), o AS (SELECT series, block, row_number() OVER (PARTITION BY series ORDER BY md5('2:' || series || ':' || block)) AS k FROM (SELECT DISTINCT series, block FROM b)), d AS (SELECT b.*, {case} AS split FROM b JOIN o USING (series, block)) SELECT series, idx, split FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE a.series = b.series AND abs(a.pos - b.pos) <= 3 AND ({touch}))"


def _windows(spark, sf_dir):
    return S.sliding(base.series(spark, sf_dir)).select("series", F.col("win").alias("idx"), F.col("win").alias("pos"), "y")


@query(sql("series", _split_sql((7, 3), ("train", "test"))))
def u7_j7_block_split(spark, sf_dir):
    return U.block_split(_windows(spark, sf_dir), 2, (7, 3)).select("series", "idx", "split")


@query(sql("series", _split_sql((6, 2, 2), ("train", "val", "test"))))
def u8_three_way_block_split(spark, sf_dir):
    return U.block_split(_windows(spark, sf_dir), 2).select("series", "idx", "split")


@query(sql("feat", "WITH m AS (SELECT dataset, feature, round(avg(value), 3) AS m, round(stddev_pop(value), 3) AS s FROM feat GROUP BY ALL) SELECT dataset, count(*) AS d, substr(sha1(count(*) || '|' || string_agg(printf('%.3f', m), ',' ORDER BY m) || '|' || string_agg(printf('%.3f', s), ',' ORDER BY s)), 1, 10) AS fp FROM m GROUP BY ALL"))
def u9_fingerprint(spark, sf_dir):
    return U.fingerprint(base.long(base.tab(spark, sf_dir)))


@query("WITH i AS (SELECT 'p' || p_partkey AS dataset, split_part(p_name, ' ', 1) || (p_size % 3) AS key, CASE WHEN p_partkey % 11 > 0 OR p_size > 3 THEN p_size % 2 END AS d FROM part) SELECT dataset, CASE WHEN count(*) OVER w > 1 AND count(d) OVER w = count(*) OVER w AND min(d) OVER w = max(d) OVER w THEN key ELSE dataset END AS dedup_group FROM i WINDOW w AS (PARTITION BY key)")
def u10_dedup_groups(spark, sf_dir):
    i = base.table(spark, sf_dir, "part").selectExpr("concat('p', p_partkey) AS dataset", "concat(substring_index(p_name, ' ', 1), p_size % 3) AS key", "CASE WHEN p_partkey % 11 > 0 OR p_size > 3 THEN p_size % 2 END AS d")
    return U.name_groups(i, "key", "d").select("dataset", "dedup_group")


@query("SELECT p_brand AS fp, 'p' || p_partkey AS dataset FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, 'p' || p_partkey) = 1")
def u11_best_per_fingerprint(spark, sf_dir):
    p = base.table(spark, sf_dir, "part").selectExpr("p_brand AS fp", "concat('p', p_partkey) AS dataset", "p_size")
    return U.best_per_fingerprint(p, "fp", "p_size").select("fp", "dataset")


_COVER = """WITH s AS (SELECT dataset, avg(x1) AS a, stddev_pop(x1) AS p, avg(x3) AS b, stddev_pop(x3) AS q, avg(x4) AS c, stddev_pop(x4) AS u FROM tab WHERE y = 0 GROUP BY ALL),
z AS (SELECT dataset, row_id, y, (x1 - a) / p AS f, (x3 - b) / q AS g, (x4 - c) / u AS h FROM tab JOIN s USING (dataset)),
d AS (SELECT i.dataset, i.row_id, min(sqrt((i.f - j.f) * (i.f - j.f) + (i.g - j.g) * (i.g - j.g) + (i.h - j.h) * (i.h - j.h))) AS d FROM z i JOIN z j ON i.dataset = j.dataset AND i.row_id <> j.row_id AND i.y = 0 AND j.y = 0 GROUP BY ALL),
r AS (SELECT dataset, quantile_cont(d, 0.5) + 1e-9 AS r FROM d GROUP BY ALL),
o AS (SELECT dataset, row_id, f, g, h, r, 0 AS step FROM z JOIN r USING (dataset) WHERE y = 1
 UNION ALL SELECT dataset, row_id, f, g, h, r, step + 1 FROM (SELECT *, first_value(f) OVER w AS ff, first_value(g) OVER w AS fg, first_value(h) OVER w AS fh FROM o WINDOW w AS (PARTITION BY dataset ORDER BY row_id))
 WHERE sqrt((f - ff) * (f - ff) + (g - fg) * (g - fg) + (h - fh) * (h - fh)) > r)
SELECT dataset, count(DISTINCT step) AS n_eff FROM o GROUP BY ALL"""


@query(sql("tab", _COVER).replace("WITH ", "WITH RECURSIVE ", 1))
def u12_effective_count(spark, sf_dir):
    return U.effective_count(base.tab(spark, sf_dir), ("x1", "x3", "x4"))


@query(sql("grade", "WITH s AS (SELECT dataset, round(max(truth) - avg(truth), 9) AS spread FROM grade GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY spread, dataset) - 1 AS k, count(*) OVER () - 1 AS m FROM s) SELECT DISTINCT dataset, spread FROM r, range(20) t(j) WHERE k = floor(j * m / 19)"))
def u13_stratified_sample(spark, sf_dir):
    s = base.grade(spark, sf_dir).groupBy("dataset").agg(F.round(F.max("truth") - F.avg("truth"), 9).alias("spread"))
    return U.even_sample(s, "spread", "dataset", 20)


# --- windows

_LIST = "SELECT series, pos // 16 AS win, list(value) OVER w AS v, max(label) OVER w AS y, count(*) OVER w AS n, pos FROM series WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING)"


@query(sql("series", f"SELECT series, win, y, round(list_sum(v), 6) AS total, v[1] AS first_value, v[64] AS last_value FROM ({_LIST}) WHERE pos % 16 = 0 AND n = 64"))
def w1_w3_sliding_windows(spark, sf_dir):
    w = S.sliding(base.series(spark, sf_dir))
    return w.select("series", "win", "y", F.round(F.expr("aggregate(v, 0.0D, (s, x) -> s + x)"), 6).alias("total"), F.expr("v[0]").alias("first_value"), F.expr("v[63]").alias("last_value"))


@query(sql("series", "SELECT series, win, y FROM (SELECT series, pos // 16 AS win, pos, (sum(label) OVER w >= 5)::INT AS y, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING)) WHERE pos % 16 = 0 AND n = 64"))
def w3_windows_of_several_labels(spark, sf_dir):
    """A window counts as anomalous from five labelled points on."""
    return S.sliding(base.series(spark, sf_dir), min_count=5).select("series", "win", "y")


_STATS = "WITH l AS (SELECT * FROM ({LIST}) WHERE pos % 16 = 0 AND n = 64), u AS (SELECT series, win, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM l), d AS (SELECT *, x - lag(x) OVER q AS d1, avg(x) OVER (PARTITION BY series, win) AS m FROM u WINDOW q AS (PARTITION BY series, win ORDER BY i)), e AS (SELECT *, d1 - lag(d1) OVER q AS d2, (x - m) * lag(x - m, 1) OVER q AS p1, (x - m) * lag(x - m, 5) OVER q AS p5 FROM d WINDOW q AS (PARTITION BY series, win ORDER BY i)) SELECT series, win, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, min(x) AS min, max(x) AS max, round(max(x) - min(x), 9) AS range, round(sqrt(avg(x * x)), 9) AS rms, round(avg(abs(d1)), 9) AS abs_d1, round(stddev_pop(d1), 9) AS std_d1, round(avg(abs(d2)), 9) AS abs_d2, round(stddev_pop(d2), 9) AS std_d2, round(sum(p1) / 64 / (var_pop(x) + 1e-12), 9) AS ac1, round(sum(p5) / 64 / (var_pop(x) + 1e-12), 9) AS ac5, round(avg((x - m) ** 3) / (stddev_pop(x) ** 3 + 1e-12), 9) AS skew, round(avg((x - m) ** 4) / (var_pop(x) ** 2 + 1e-12) - 3, 9) AS kurt, round(quantile_cont(x, 0.1), 9) AS q10, round(quantile_cont(x, 0.5), 9) AS q50, round(quantile_cont(x, 0.9), 9) AS q90, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 9) AS iqr, round(sum(CASE WHEN p1 < 0 THEN 1.0 ELSE 0 END) / 63, 9) AS zero_cross FROM e GROUP BY ALL"
_NAMES = "mean std min max range rms abs_d1 std_d1 abs_d2 std_d2 ac1 ac5 skew kurt q10 q50 q90 iqr zero_cross".split()


@query(sql("series", _STATS.replace("{LIST}", _LIST)))
def w2_window_statistics(spark, sf_dir):
    f = S.statistics(S.sliding(base.series(spark, sf_dir)))
    return f.select("series", "win", *[c if c in ("min", "max") else F.round(c, 9).alias(c) for c in _NAMES])


@query()
def w2_window_descriptor(spark, sf_dir):
    """All 28 features, the five spectral ones included."""
    return S.describe(S.sliding(base.series(spark, sf_dir)))


_EIGHT = "mean std min max range rms abs_d1 ac1".split()


@query(sql("series", f"SELECT series, win, {', '.join(_EIGHT)} FROM ({_STATS.replace('{LIST}', _LIST)})"))
def w4_channel_features(spark, sf_dir):
    f = S.channel_features(S.sliding(base.series(spark, sf_dir)))
    return f.select("series", "win", *[c if c in ("min", "max") else F.round(c, 9).alias(c) for c in _EIGHT])


@query(sql("series", "SELECT series, pos, round(avg(value) OVER w, 9) AS m, round(stddev_pop(value) OVER w, 9) AS s FROM series WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING)"))
def w5_moving_mean_and_deviation(spark, sf_dir):
    m = S.moving(base.series(spark, sf_dir), "value", 32)
    return m.select("series", "pos", F.round("m", 9).alias("m"), F.round("s", 9).alias("s"))


def _liners_sql() -> str:
    change = "SELECT *, abs(d) AS a FROM (SELECT series, pos, value, label, coalesce(value - lag(value) OVER (PARTITION BY series ORDER BY pos), 0) AS d FROM series)"
    smooth = ", ".join(f"avg({b}) OVER w{k} AS {b}m{k}, stddev_pop({b}) OVER w{k} AS {b}s{k}" for b, k in product("ad", S.SMOOTHING))
    frames = ", ".join(f"w{k} AS (PARTITION BY series ORDER BY pos ROWS BETWEEN {k // 2} PRECEDING AND {k // 2} FOLLOWING)" for k in S.SMOOTHING)
    stats = ", ".join(["a AS a_0", "d AS d_0"] + [f"{b} - ({u} * {b}m{k} + {c} * {b}s{k}) AS {b}_{k}_{u}_{c}" for b, k, u, c in product("ad", S.SMOOTHING, S.SPREADS, S.OFFSETS)])
    return f"c AS ({change}), m AS (SELECT *, {smooth} FROM c WINDOW {frames}), o AS (SELECT series, pos, label, {stats} FROM m)"


@query(sql("series", f"WITH {_liners_sql()} SELECT series, pos, round(a_0, 6) AS a_0, round(a_8_1_1, 6) AS a_8_1_1, round(d_128_1_3, 6) AS d_128_1_3, round(d_512_0_1, 6) AS d_512_0_1 FROM o"))
def w6_one_liners(spark, sf_dir):
    return S.one_liners(base.series(spark, sf_dir)).select("series", "pos", *[F.round(c, 6).alias(c) for c in ("a_0", "a_8_1_1", "d_128_1_3", "d_512_0_1")])


@query(sql("series", f"WITH {_liners_sql()}, l AS (UNPIVOT o ON {', '.join(S.one_liner_names())} INTO NAME stat VALUE x), t AS (SELECT series, label FROM l QUALIFY row_number() OVER (PARTITION BY series, stat ORDER BY x DESC, pos) = 1) SELECT series, sum(label)::INT AS hits, sum(label) > 0 AS trivial FROM t GROUP BY ALL"))
def w7_argmax_triviality(spark, sf_dir):
    return S.argmax_trivial(base.series(spark, sf_dir))


@query(sql("series", f"WITH {_liners_sql()}, l AS (UNPIVOT (SELECT series, pos, {', '.join(S.one_liner_names())} FROM o) ON {', '.join(S.one_liner_names())} INTO NAME stat VALUE x), r AS (SELECT series, pos, stat, rank() OVER (PARTITION BY series, stat ORDER BY x) + (count(*) OVER (PARTITION BY series, stat, x) - 1) / 2.0 AS r FROM l), b AS (SELECT series, pos, n, sum(label) OVER (PARTITION BY series) AS a FROM (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM series) WHERE label = 1), mv AS (SELECT series, n, a, s, (pos + floor(s * n / 100)::BIGINT) % n AS pos FROM b, range(100) t(s)), u AS (SELECT series, stat, s, (sum(r) - max(a) * (max(a) + 1) / 2.0) / (max(a) * (max(n) - max(a))) AS u FROM mv JOIN r USING (series, pos) GROUP BY ALL), x AS (SELECT series, s, max(greatest(u, 1 - u)) AS b FROM u GROUP BY ALL) SELECT series, round(max(CASE WHEN s = 0 THEN b END), 6) AS observed, round(quantile_cont(CASE WHEN s > 0 THEN b END, 0.95), 6) AS threshold FROM x GROUP BY ALL"))
def w8_permutation_triviality(spark, sf_dir):
    return S.permutation_trivial(base.series(spark, sf_dir), S.one_liner_names()).select("series", F.round("observed", 6).alias("observed"), F.round("threshold", 6).alias("threshold"))


_CALIBRATION = f"""WITH {_liners_sql()}, l AS (UNPIVOT o ON {', '.join(S.one_liner_names())} INTO NAME stat VALUE x),
r AS (SELECT series, stat, label, rank() OVER (PARTITION BY series, stat ORDER BY x) + (count(*) OVER (PARTITION BY series, stat, x) - 1) / 2.0 AS r,
  row_number() OVER (PARTITION BY series, stat ORDER BY x DESC, pos) AS k, count(*) OVER (PARTITION BY series, stat) AS n FROM l),
g AS (SELECT series, stat, max(CASE WHEN k = 1 THEN label END) AS hit, avg(CASE WHEN k <= ceil(n * 0.01) THEN label END) AS p,
  (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auc FROM r GROUP BY ALL)
SELECT stat, round(avg(hit), 6) AS argmax_rate, round(avg(auc), 6) AS mean_auc, round(avg(p), 6) AS top1_precision FROM g GROUP BY ALL"""


@query(sql("series", _CALIBRATION))
def w9_criterion_calibration(spark, sf_dir):
    c = S.calibration(base.series(spark, sf_dir), S.one_liner_names())
    return c.select("stat", *[F.round(x, 6).alias(x) for x in ("argmax_rate", "mean_auc", "top1_precision")])


@query(sql("series", "SELECT series, pos // 16 AS win, s AS score, y FROM (SELECT series, pos, max(value) OVER w AS s, max(label) OVER w AS y, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING)) WHERE pos % 16 = 0 AND n = 64"))
def w10_window_scores(spark, sf_dir):
    return S.window_scores(base.series(spark, sf_dir), "value")
