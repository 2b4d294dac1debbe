"""Queries of joins, set operations, scalar functions, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F


from siftlake.plans import base
from siftlake.plans.base import sql
from siftlake.plans.registry import query
from siftlake.session import shared_folder
from siftlake.sources import files, synthetic
from siftlake.streaming import windows as stream


@query(sql("fact", "SELECT f.dataset, f.detector, count(*) AS n, round(avg(f.pseudo - g.truth), 9) AS gap FROM fact f JOIN (SELECT dataset, detector, truth FROM fact WHERE subset = 'A') g ON f.dataset = g.dataset AND f.detector = g.detector GROUP BY ALL"))
def j1_inner_join(spark, sf_dir):
    f = base.fact(spark, sf_dir)
    g = f.where("subset = 'A'").select("dataset", "detector", F.col("truth").alias("t"))
    return f.join(g, ["dataset", "detector"]).groupBy("dataset", "detector").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("pseudo") - F.col("t")), 9).alias("gap"))


@query(sql("fact", "SELECT dataset, subset, detector, round(var_samp(pseudo) OVER (PARTITION BY dataset, subset), 9) AS v FROM fact"))
def j2_group_statistic(spark, sf_dir):
    return base.fact(spark, sf_dir).select("dataset", "subset", "detector", F.round(F.var_samp("pseudo").over(W.partitionBy("dataset", "subset")), 9).alias("v"))


@query("SELECT c_custkey, o.n, CASE WHEN o.n IS NULL THEN 'none' ELSE 'some' END AS note FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY ALL) o ON c_custkey = o_custkey")
def j3_left_join(spark, sf_dir):
    o = base.table(spark, sf_dir, "orders").where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return base.table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").withColumn("note", F.expr("CASE WHEN n IS NULL THEN 'none' ELSE 'some' END"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 18 GROUP BY ALL) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY ALL) b ON a.k = b.k")
def j4_j10_full_join_with_fill(spark, sf_dir):
    a = base.table(spark, sf_dir, "customer").where("c_nationkey < 18").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = base.table(spark, sf_dir, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "k", "full").select("k", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j5_semi_join(spark, sf_dir):
    c = base.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return base.table(spark, sf_dir, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j6_anti_join(spark, sf_dir):
    o = base.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return base.table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query(sql("grade", "SELECT a.dataset, round(avg(a.pseudo - b.truth), 11) AS d, count(*) AS n FROM grade a JOIN grade b ON a.dataset = b.dataset AND a.detector = b.detector WHERE a.detector IN ('k1', 'k2', 'k3') AND b.detector NOT IN ('k3') GROUP BY ALL"))
def j11_common_index(spark, sf_dir):
    g = base.grade(spark, sf_dir)
    a = g.where("detector IN ('k1', 'k2', 'k3')").select("dataset", "detector", "pseudo")
    return a.join(g.where("detector NOT IN ('k3')").select("dataset", "detector", "truth"), ["dataset", "detector"]).groupBy("dataset").agg(F.round(F.avg(F.col("pseudo") - F.col("truth")), 11).alias("d"), F.count(F.lit(1)).alias("n"))


@query("SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_operations(spark, sf_dir):
    c, s, o = (base.table(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))
    keys = c.select(F.col("c_custkey").alias("k"))
    used = o.select(F.col("o_custkey").alias("k"))
    parts = (("union", c.select("c_nationkey").unionAll(s.select("s_nationkey"))), ("intersect", keys.intersect(used)), ("except", keys.subtract(used)))
    out = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n") for name, p in parts]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_quantity LIMIT 50")
def sort_and_limit(spark, sf_dir):
    return base.table(spark, sf_dir, "lineitem").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_quantity").select("l_orderkey", "l_linenumber", "l_extendedprice").limit(50)


@query(sql("series", "SELECT series, pos, round(sum(value) OVER w, 6) AS total, round(value - lag(value) OVER w, 6) AS change, first_value(value) OVER (PARTITION BY series ORDER BY value DESC, pos) AS top FROM series WINDOW w AS (PARTITION BY series ORDER BY pos)"))
def analytic_functions(spark, sf_dir):
    w = W.partitionBy("series").orderBy("pos")
    top = F.first("value").over(W.partitionBy("series").orderBy(F.col("value").desc(), "pos"))
    return base.series(spark, sf_dir).select("series", "pos", F.round(F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)), 6).alias("total"), F.round(F.col("value") - F.lag("value").over(w), 6).alias("change"), top.alias("top"))


@query(sql("grade", "SELECT modality, corpus, round(avg(truth), 11) AS truth, grouping(modality, corpus) AS level FROM grade GROUP BY GROUPING SETS ((modality), (corpus), ())"))
def grouping_sets(spark, sf_dir):
    base.grade(spark, sf_dir).createOrReplaceTempView("siftlake_grade")
    return spark.sql("SELECT modality, corpus, round(avg(truth), 11) AS truth, grouping_id(modality, corpus) AS level FROM siftlake_grade GROUP BY GROUPING SETS ((modality), (corpus), ())")


@query("SELECT event_id, (props::JSON->>'k')::INT AS k, md5(event_type) AS m, sha1(event_type) AS s, upper(substr(event_type, 1, 3)) AS u, length(event_type) AS n, replace(event_type, 'i', '_') AS r, round(ln(value + 1), 6) AS l, round(exp(-value / 100), 6) AS e, sign(value - 50)::DOUBLE AS sg, floor(value)::BIGINT AS f, round(sqrt(value), 6) AS q FROM events")
def scalar_functions(spark, sf_dir):
    e = base.table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.md5("event_type").alias("m"), F.sha1("event_type").alias("s"), F.upper(F.substring("event_type", 1, 3)).alias("u"), F.length("event_type").alias("n"), F.replace("event_type", F.lit("i"), F.lit("_")).alias("r"), F.round(F.ln(F.col("value") + 1), 6).alias("l"), F.round(F.exp(-F.col("value") / 100), 6).alias("e"), F.signum(F.col("value") - 50).alias("sg"), F.floor("value").alias("f"), F.round(F.sqrt("value"), 6).alias("q"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS squared, len(embedding) AS d, embedding[1]::DOUBLE AS first_value FROM embeddings")
def array_functions(spark, sf_dir):
    e = base.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.expr("aggregate(embedding, 0.0D, (s, x) -> s + double(x) * double(x))"), 5).alias("squared"), F.size("embedding").alias("d"), F.col("embedding")[0].cast("double").alias("first_value"))


# --- sources and streams


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(sql("grade", "SELECT dataset, detector, truth, pseudo FROM grade"))
def s10_s11_csv_and_parquet_round_trip(spark, sf_dir):
    g = base.grade(spark, sf_dir).select("dataset", "detector", "truth", "pseudo")
    csv, parquet = _folder(spark, "csv"), _folder(spark, "parquet")
    files.write_csv(g, csv)
    files.read_csv(spark, csv, g.schema).write.parquet(parquet)
    return files.require_columns(spark.read.parquet(parquet), {"dataset", "detector", "truth"})


@query(sql("grade", "SELECT dataset, detector, truth FROM grade"))
def s12_resumed_append(spark, sf_dir):
    g = base.grade(spark, sf_dir).select("dataset", "detector", "truth")
    path = _folder(spark, "results")
    files.append_results(g.where("detector < 'k4'"), path, ["dataset", "detector"])
    files.append_results(g, path, ["dataset", "detector"])
    return spark.read.schema(g.schema).json(path)


@query(sql("grade", "SELECT corpus, count(*) AS n, round(avg(CASE WHEN corpus = 'c1' THEN pseudo ELSE truth END), 11) AS m FROM grade GROUP BY ALL"))
def s13_s14_partitions_replaced(spark, sf_dir):
    g = base.grade(spark, sf_dir).select("dataset", "detector", "corpus", F.col("truth").alias("v"), "pseudo")
    path = _folder(spark, "parts")
    files.replace_parts(g.drop("pseudo"), path, "corpus")
    files.replace_parts(g.where("corpus = 'c1'").withColumn("v", F.col("pseudo")).drop("pseudo"), path, "corpus")
    return spark.read.parquet(path).groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 11).alias("m"))


@query(sql("grade", "SELECT dataset AS key, detector, truth AS ap, a1 FROM grade"))
def d17_json_records(spark, sf_dir):
    g = base.grade(spark, sf_dir).groupBy(F.col("dataset").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("detector", "truth"))).alias("ap"), F.map_from_entries(F.collect_list(F.struct("detector", "a1"))).alias("a1"))
    path = _folder(spark, "records")
    g.write.json(path)
    return files.read_records(spark, path)


@query()
def s7_synthetic_tables(spark, sf_dir):
    return synthetic.tables(spark)


@query()
def s8_synthetic_series(spark, sf_dir):
    return synthetic.series(spark, 4000)


def _event_stream(spark, sf_dir):
    """The events table as a stream, one file a batch."""
    path = _folder(spark, "events")
    events = base.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(path)
    return spark.readStream.schema(events.schema).parquet(path)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS d, value FROM events) GROUP BY ALL")
def streaming_tumbling_windows(spark, sf_dir):
    """Daily windows of a stream in complete mode, added up by type."""
    e = _event_stream(spark, sf_dir)
    out = stream.run_available(stream.tumbling(e, width="1 day"), _folder(spark, "tumbling"), _folder(spark, "state"), "complete")
    return out.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("mean")), 4).alias("total"))


_SESSIONS = """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, s"""


@query(_SESSIONS)
def streaming_sessions(spark, sf_dir):
    """Bursts of a user's events that are less than six hours apart, from a stream in complete mode."""
    e = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = stream.run_available(stream.sessions(e, gap="6 hours"), _folder(spark, "sessions"), _folder(spark, "state"), "complete")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(sql("series", "SELECT series, pos // 16 AS win, y FROM (SELECT series, pos, max(label) OVER w AS y, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND 63 FOLLOWING)) WHERE pos % 16 = 0 AND n = 64"))
def streaming_row_windows(spark, sf_dir):
    """The 64-row windows of the batch operator, from a stream with state."""
    path = _folder(spark, "series")
    s = base.series(spark, sf_dir)
    s.write.parquet(path)
    e = spark.readStream.schema(s.schema).parquet(path)
    out = stream.run_available(stream.row_windows(e), _folder(spark, "rows"), _folder(spark, "state"))
    return out.select("series", "win", "y")
