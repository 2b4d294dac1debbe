"""Hardening: anomalies that a trivial rule finds are removed; and the funnel of a benchmark's construction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions.ranks import running_totals
from siftlake.operators import detectors as D
from siftlake.operators import space
from siftlake.session import stored


def within_normals(rows: DataFrame, rules: list[DataFrame], level: float = 0.99) -> DataFrame:
    """Normals, and the anomalies that no rule (dataset, row_id, score) puts above the normals' quantile."""
    out = rows
    for k, rule in enumerate(rules):
        s = rows.select("dataset", "row_id", "y").join(rule, ["dataset", "row_id"])
        cut = s.where("y = 0").groupBy("dataset").agg(F.percentile("score", level).alias("_q"))
        bad = s.where("y = 1").join(cut, "dataset").where(F.col("score") > F.col("_q")).select("dataset", "row_id")
        out = out.join(bad, ["dataset", "row_id"], "left_anti")
    return out


def double_hard(rows: DataFrame, features: tuple[str, ...], level: float = 0.99) -> DataFrame:
    """Rows left by the largest z-score and the linear residual together, both fitted on normals."""
    normal = rows.where("y = 0")
    return within_normals(rows, [D.max_z(rows, features, train=normal), D.linear_residual(rows, features, train=normal)], level)


def level_sweep(rows: DataFrame, rules: list[DataFrame], levels: tuple[float, ...]) -> DataFrame:
    """(dataset, level, kept, share): anomalies that no rule puts above the normals' quantile at each level; the rules are scored once."""
    s = rows.select("dataset", "row_id", "y")
    for k, rule in enumerate(rules):
        s = s.join(rule.select("dataset", "row_id", F.col("score").alias(f"_s{k}")), ["dataset", "row_id"])
    s = stored(s, "sweep")
    cuts = s.where("y = 0").groupBy("dataset").agg(*[F.percentile(f"_s{k}", F.array(*[F.lit(x) for x in levels])).alias(f"_q{k}") for k in range(len(rules))])
    at = s.where("y = 1").join(cuts, "dataset").select("*", F.posexplode(F.array(*[F.lit(x) for x in levels])).alias("_i", "level"))
    hard = reduce(lambda a, b: a & b, [F.col(f"_s{k}") <= F.expr(f"_q{k}[_i]") for k in range(len(rules))])
    return at.groupBy("dataset", "level").agg(F.count(F.when(hard, 1)).alias("kept"), F.avg(F.when(hard, 1.0).otherwise(0.0)).alias("share"))


def severity(rows: DataFrame, features: tuple[str, ...], bins: int = 30, splits: int | None = None, train: DataFrame | None = None) -> DataFrame:
    """(dataset, row_id, score): over features, the larger of the two-sided tail and the bin rarity against ``train`` (or the
    normals).

    With F the share of training values up to the value, the tail is -ln of twice the smaller of F and 1 - F, at least
    1 / 2m; rarity is -ln(density + 1e-9), values outside the range falling into the end bins. Both are lookups in tables of
    training values: by running counts over distinct values (dealt over ``splits`` tasks), and by bins. Constant features
    say nothing.
    """
    by = ["dataset", "feature"]
    f = D.long(rows, features)
    t = D.long(rows.where("y = 0") if train is None else train, features)
    counts = t.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("c"))
    c = counts.unionByName(f.select(*by, "value", F.lit(0).cast("bigint").alias("c"))).groupBy(*by, "value").agg(F.sum("c").alias("c"))
    ends = t.groupBy(*by).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("hi - lo >= 1e-12")
    v = running_totals(c, by, "value", ["c"], splits).join(ends, by).withColumn("m", F.col("all_c"))
    v = v.withColumn("tail", F.expr("-ln(greatest(2 * least((m - cum_c + c) / m, (cum_c - c) / m), 1 / (2.0D * m)))"))
    v = v.withColumn("bin", F.expr(f"least(greatest(cast(floor((value - lo) / (hi - lo) * {bins}) as int) + 1, 1), {bins})"))
    d = v.groupBy(*by, "bin").agg((F.sum("c") / F.max("m")).alias("density"))
    s = v.join(d, [*by, "bin"]).select(*by, "value", F.greatest("tail", -F.ln(F.col("density") + 1e-9)).alias("s"))
    out = f.join(s, [*by, "value"], "left").groupBy("dataset", "row_id").agg(F.max("s").alias("score"))
    return out.withColumn("score", F.coalesce("score", F.lit(0.0)))


def two_stage(rows: DataFrame, features: tuple[str, ...], level: float = 0.95, variance: float = 0.95, seed: object = 0) -> DataFrame:
    """Normals, and the anomalies that are trivial neither in the features nor in whitened principal coordinates.

    Scales, axes and severities come from the first 80 % of the normals in a hash order, the thresholds from the other 20 %.
    """
    from siftlake.operators.pseudo import true_roles

    roles = rows.join(true_roles(rows, seed), ["dataset", "row_id"])
    train = roles.where("role = 'train'").drop("role")
    asked = roles.where("role <> 'train'").drop("role")
    axes = space.principal_axes(space.standardise(train, features), features).select("dataset", "values", "axes")
    before = "aggregate(slice(values, 1, {i}), 0.0D, (s, v) -> s + v) < " + f"{variance} * aggregate(values, 0.0D, (s, v) -> s + v)"
    white = [F.expr(f"CASE WHEN {before.format(i=i)} AND values[{i}] > 1e-9 THEN aggregate(zip_with(axes[{i}], _x, (p, q) -> p * q), 0.0D, (s, t) -> s + t) / sqrt(values[{i}]) ELSE 0.0D END").alias(f"w{i}") for i in range(len(features))]

    def coordinates(x: DataFrame) -> DataFrame:
        return space.standardise(x, features, train).join(axes, "dataset").withColumn("_x", F.array(*features)).select("dataset", "row_id", "y", *white)

    names = tuple(f"w{i}" for i in range(len(features)))
    rules = [severity(asked, features, train=train), severity(coordinates(asked), names, train=coordinates(train))]
    kept = within_normals(asked, rules, level)
    return rows.where("y = 0").unionByName(kept.where("y = 1").select(*rows.columns))


def funnel(items: DataFrame, stages: list[tuple[str, str]]) -> DataFrame:
    """(stage, name, left): how many items pass each SQL condition after all before it, in one aggregation."""
    upto, counts = "true", []
    for k, (name, condition) in enumerate(stages):
        upto = f"{upto} AND ({condition})"
        counts.append(F.struct(F.lit(k).alias("stage"), F.lit(name).alias("name"), F.sum(F.expr(f"CASE WHEN {upto} THEN 1 ELSE 0 END")).alias("left")))
    return items.agg(F.array(*counts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def manifest(facts: DataFrame, truth: str, base_rate: str, rule_auc: str, least_best: float = 0.1, least_spread: float = 0.1, most_rate: float = 0.25, trivial: float = 0.85, least_variants: int = 5) -> DataFrame:
    """(dataset, n_variants, gt_best, spread, rule_trivial, include, gt_ranking): the inclusion rule of the benchmark."""
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col(truth)).alias("t"), F.col("detector").alias("d")))), lambda s: s["d"])
    g = facts.groupBy("dataset").agg(F.count(truth).alias("n_variants"), F.max(truth).alias("gt_best"), (F.max(truth) - F.avg(truth)).alias("spread"), F.max(base_rate).alias("base_rate"), (F.max(rule_auc) > trivial).alias("rule_trivial"), F.concat_ws("|", ranked).alias("gt_ranking"))
    ok = (F.col("gt_best") >= least_best) & (F.col("spread") >= least_spread) & (F.col("base_rate") <= most_rate) & ~F.col("rule_trivial") & (F.col("n_variants") >= least_variants)
    return g.withColumn("include", ok)


def drop_reasons(items: DataFrame, by: str, reasons: list[tuple[str, str]]) -> DataFrame:
    """(by, fate, n): each item's first failing condition, or 'kept'."""
    case = reduce(lambda c, r: c.when(F.expr(r[1]), r[0]), reasons[1:], F.when(F.expr(reasons[0][1]), reasons[0][0]))
    return items.groupBy(by, case.otherwise("kept").alias("fate")).agg(F.count(F.lit(1)).alias("n"))
