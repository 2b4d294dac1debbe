"""Projections, filters and row-level cleaning: every function takes and returns DataFrames of (dataset, ...) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions.ranks import draw_order

#: Detector families by name prefix. Fixed values.
LOCAL = ("LOF", "KNN", "CBLOF")
GLOBAL = ("HBOS", "COPOD", "ECOD", "PCA")


def finite_or_zero(value: Column) -> Column:
    """NaN, NULL and infinities become 0."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def missing_to_null(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def drop_degenerate(scores: DataFrame, by: list[str], score: str = "score", least: float = 1e-12) -> DataFrame:
    """Rows of the groups whose scores are all finite and vary."""
    bad = F.sum(F.when(F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf")), 1).otherwise(0))
    # deviations of non-finite scores would be NaN: they are replaced before and counted apart
    good = scores.groupBy(*by).agg(bad.alias("_bad"), F.stddev_pop(finite_or_zero(F.col(score))).alias("_sd")).where((F.col("_bad") == 0) & (F.col("_sd") >= least))
    return scores.join(good.select(*by), by, "left_semi")


def size_gates(rows: DataFrame, by: list[str], least_rows: int, least_anomalies: int, least_normals: int, most_rows: int | None = None) -> DataFrame:
    """Rows of the groups that are large enough; the counts are one partial aggregation."""
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("a"))
    ok = (F.col("n") >= least_rows) & (F.col("a") >= least_anomalies) & (F.col("n") - F.col("a") >= least_normals)
    if most_rows is not None:
        ok = ok & (F.col("n") <= most_rows)
    return rows.join(n.where(ok).select(*by), by, "left_semi")


def cap_rows(rows: DataFrame, by: list[str], n: int, seed: object, key: str) -> DataFrame:
    """At most ``n`` rows of each group, in MD5 order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(draw_order(seed, key)))).where(F.col("_n") <= n).drop("_n")


def cap_base_rate(rows: DataFrame, by: list[str], rate: float, seed: object, key: str) -> DataFrame:
    """All normals, and anomalies in MD5 order up to rate * normals / (1 - rate)."""
    normals = F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).over(W.partitionBy(*by))
    place = F.row_number().over(W.partitionBy(*by, "y").orderBy(draw_order(seed, key)))
    return rows.withColumn("_c", F.floor(normals * rate / (1 - rate))).withColumn("_n", place).where("y = 0 OR _n <= _c").drop("_c", "_n")


def centred_truncation(series: DataFrame, most: int) -> DataFrame:
    """At most ``most`` points of each series, centred on the middle of its labelled span and clamped to its ends."""
    s = series.groupBy("series").agg(F.min(F.when(F.col("label") == 1, F.col("pos"))).alias("a"), F.max(F.when(F.col("label") == 1, F.col("pos"))).alias("b"), F.count(F.lit(1)).alias("n"))
    middle = F.coalesce(F.floor((F.col("a") + F.col("b")) / 2), F.floor(F.col("n") / 2))
    first = F.greatest(F.lit(0), F.least(middle - most // 2, F.col("n") - most))
    return series.join(s.select("series", first.alias("_f")), "series").where((F.col("pos") >= F.col("_f")) & (F.col("pos") < F.col("_f") + most)).drop("_f")


def top_channels(long: DataFrame, by: list[str], channel: str, value: str, n: int) -> DataFrame:
    """(by, channel, place) of the ``n`` channels with the largest deviation."""
    sd = long.groupBy(*by, channel).agg(F.stddev_pop(value).alias("sd"))
    return sd.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.col("sd").desc(), channel))).where(F.col("place") <= n).select(*by, channel, "place")


def normal_name(name: Column) -> Column:
    """Lower case, without a final .npz, .csv or .txt, leading digits with their underscore, underscores and hyphens."""
    bare = F.regexp_replace(name, r"\.(npz|csv|txt)$", "")
    return F.regexp_replace(F.lower(F.regexp_replace(bare, r"^[0-9]+_", "")), r"[_-]", "")


def source_family(link: Column, table: Column, name: Column) -> Column:
    """gh:owner/repo, or tl: and the table's origin before '_part', or nm: and the name's stem."""
    repo = F.regexp_extract(F.coalesce(link, F.lit("")), r"github\.com/([^/]+/[^/]+)", 1)
    origin = F.regexp_replace(F.coalesce(table, F.lit("")), r"_part.*$", "")
    return F.when(repo != "", F.concat(F.lit("gh:"), repo)).when(origin != "", F.concat(F.lit("tl:"), origin)).otherwise(F.concat(F.lit("nm:"), F.regexp_replace(F.lower(name), r"[0-9_]+$", "")))


def detector_family(variant: Column) -> Column:
    """local, global or other, by prefix."""
    return F.when(variant.rlike(f"^({'|'.join(LOCAL)})"), "local").when(variant.rlike(f"^({'|'.join(GLOBAL)})"), "global").otherwise("other")


def detector_kind(variant: Column) -> Column:
    """The five-way split: neighbor, distribution, projection, isolation, deep."""
    return F.when(variant.rlike("^(LOF|KNN|CBLOF)"), "neighbor").when(variant.rlike("^(HBOS|COPOD|ECOD)"), "distribution").when(variant.rlike("^(PCA|LODA|LinRes)"), "projection").when(variant.rlike("^IForest"), "isolation").otherwise("deep")


def parent_key(key: Column) -> Column:
    return F.substring_index(key, "__", 2)


def segments(series: DataFrame) -> DataFrame:
    """(series, first, last, length) of maximal runs of labelled points."""
    on = series.where("label = 1").withColumn("_g", F.col("pos") - F.row_number().over(W.partitionBy("series").orderBy("pos")))
    return on.groupBy("series", "_g").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("length")).drop("_g")


def range_series(series: DataFrame, least_length: int = 32, least_share: float = 0.5) -> DataFrame:
    """(series, share): series where at least that share of labelled points lies in long runs."""
    s = segments(series).groupBy("series").agg((F.sum(F.when(F.col("length") >= least_length, F.col("length")).otherwise(0)) / F.sum("length")).alias("share"))
    return s.where(F.col("share") >= least_share)


def window_purity(series: DataFrame, width: int = 64, stride: int = 16) -> DataFrame:
    """(series, pos, purity): the share of labelled points in each whole window."""
    w = W.partitionBy("series").orderBy("pos").rowsBetween(0, width - 1)
    r = series.select("series", "pos", F.avg("label").over(w).alias("purity"), F.count(F.lit(1)).over(w).alias("_n"))
    return r.where((F.col("pos") % stride == 0) & (F.col("_n") == width)).drop("_n")
