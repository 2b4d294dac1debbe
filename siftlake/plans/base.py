"""The driver tables in the roles of the reference's inputs, each as a DataFrame and as a common table expression.

tab: tabular rows, one for each order of ``lineitem``; asked: those whose id is divisible by 100, the stated queries of the
neighbour operators, which meet all rows; feat: one row for each feature; fact: detector grades for each supplier; series: ``events`` in order; point: scores against labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FEATURES = ("x1", "x2", "x3", "x4")

_SQL = {
    "tab": ((), "SELECT 'd' || (l_orderkey % 3) AS dataset, l_orderkey AS row_id, sum(l_quantity) AS x1, avg(l_extendedprice) AS x2, avg(l_discount) AS x3, avg(l_tax) AS x4, CASE WHEN max(l_discount) >= 0.1 AND count(*) < 4 THEN 1 ELSE 0 END AS y FROM lineitem GROUP BY l_orderkey"),
    "asked": (("tab",), "SELECT * FROM tab WHERE row_id % 100 = 0"),
    "feat": (("tab",), " UNION ALL ".join(f"SELECT dataset, row_id, y, '{f}' AS feature, {f} AS value FROM tab" for f in FEATURES)),
    "zfeat": (("feat",), "SELECT dataset, row_id, y, feature, value, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-9) AS z FROM feat WINDOW w AS (PARTITION BY dataset, feature)"),
    "point": (("zfeat",), "SELECT dataset, feature AS detector, row_id, y, round(abs(z), 7) AS score FROM zfeat"),
    "fact": (
        (),
        "SELECT 's' || l_suppkey AS dataset, 'k' || l_linenumber AS detector, l_returnflag AS subset, CASE WHEN l_suppkey % 3 = 0 THEN 'timeseries' ELSE 'tabular' END AS modality, 'c' || (l_suppkey % 5) AS corpus, "
        "round(avg(l_discount) * 10, 6) AS pseudo, round(avg(l_tax) * 12, 6) AS truth, round(avg(l_quantity) / 50, 6) AS a1, round(avg(l_extendedprice) / 100000, 6) AS a4 FROM lineitem GROUP BY l_suppkey, l_linenumber, l_returnflag",
    ),
    "grade": (("fact",), "SELECT dataset, detector, modality, corpus, round(avg(pseudo), 6) AS pseudo, round(avg(truth), 6) AS truth, round(avg(a1), 6) AS a1, round(avg(a4), 6) AS a4 FROM fact GROUP BY ALL"),
    "series": ((), "SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos, value, CASE WHEN value > 180 THEN 1 ELSE 0 END AS label FROM events"),
}


def sql(names: str, body: str) -> str:
    """``body`` with the named expressions, and what they need, before it."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in _SQL[name][0]:
            add(n)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({_SQL[n][1]})" for n in wanted) + (", " + body[5:] if body.startswith("WITH ") else " " + body)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    g = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("x1"), F.avg("l_extendedprice").alias("x2"), F.avg("l_discount").alias("x3"), F.avg("l_tax").alias("x4"), F.max("l_discount").alias("d"), F.count(F.lit(1)).alias("n"))
    return g.select(F.concat(F.lit("d"), (F.col("l_orderkey") % 3).cast("string")).alias("dataset"), F.col("l_orderkey").alias("row_id"), *FEATURES, F.expr("CASE WHEN d >= 0.1 AND n < 4 THEN 1 ELSE 0 END").alias("y"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tab(spark, sf_dir).where("row_id % 100 = 0")


def long(df: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row for each feature."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in features]))
    return df.select("dataset", "row_id", "y", pairs.alias("p")).select("dataset", "row_id", "y", "p.feature", "p.value")


def with_z(feat: DataFrame) -> DataFrame:
    w = W.partitionBy("dataset", "feature")
    return feat.withColumn("z", (F.col("value") - F.avg("value").over(w)) / (F.stddev_pop("value").over(w) + 1e-9))


def point(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = with_z(long(tab(spark, sf_dir)))
    return z.select("dataset", F.col("feature").alias("detector"), "row_id", "y", F.round(F.abs("z"), 7).alias("score"))


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber", "l_returnflag")
    g = g.agg(F.round(F.avg("l_discount") * 10, 6).alias("pseudo"), F.round(F.avg("l_tax") * 12, 6).alias("truth"), F.round(F.avg("l_quantity") / 50, 6).alias("a1"), F.round(F.avg("l_extendedprice") / 100000, 6).alias("a4"))
    return g.select(F.expr("concat('s', l_suppkey)").alias("dataset"), F.expr("concat('k', l_linenumber)").alias("detector"), F.col("l_returnflag").alias("subset"), F.expr("CASE WHEN l_suppkey % 3 = 0 THEN 'timeseries' ELSE 'tabular' END").alias("modality"), F.expr("concat('c', l_suppkey % 5)").alias("corpus"), "pseudo", "truth", "a1", "a4")


def grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir).groupBy("dataset", "detector", "modality", "corpus").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("pseudo", "truth", "a1", "a4")])


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), pos.cast("bigint").alias("pos"), "value", F.expr("CASE WHEN value > 180 THEN 1 ELSE 0 END").alias("label"))
