"""Generated tables and series with known anomalies, as expressions over ``spark.range``: any size, in any number of tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators.synth import hash_uniform


def _gauss(seed: object, tag: str, at: Column) -> Column:
    """A normal draw from two hash-uniform ones (Box-Muller)."""
    u = F.greatest(hash_uniform(seed, f"{tag}:u", at), F.lit(1e-12))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * hash_uniform(seed, f"{tag}:v", at))


def _span(seed: object, tag: str, at: Column, lo: float, hi: float) -> Column:
    return lo + (hi - lo) * hash_uniform(seed, tag, at)


def tables(spark: SparkSession, n_normal: int = 1500, n_anomalies: int = 60, seed: int = 0) -> DataFrame:
    """(dataset, row_id, features, y): blobs, two moons, a ring, many dimensions with wider anomalies, and a dense clump."""
    rows = spark.range(n_normal + n_anomalies).withColumnRenamed("id", "row_id").withColumn("y", (F.col("row_id") >= n_normal).cast("int"))
    at, odd = F.col("row_id"), F.col("y") == 1
    part = (at % 4).cast("string")

    def blobs(j: int) -> Column:
        centre = 3 * _gauss(seed, f"centre{j}", part)
        return F.when(odd, _span(seed, f"a{j}", at, -8, 8)).otherwise(centre + 0.6 * _gauss(seed, f"n{j}", at))

    angle = math.pi * hash_uniform(seed, "moon", at)
    upper = at % 2 == 0
    moon = [F.when(upper, F.cos(angle)).otherwise(1 - F.cos(angle)) + 0.05 * _gauss(seed, "m0", at), F.when(upper, F.sin(angle)).otherwise(0.5 - F.sin(angle)) + 0.05 * _gauss(seed, "m1", at)]
    theta, r = 2 * math.pi * hash_uniform(seed, "ring", at), 3 + 0.1 * _gauss(seed, "radius", at)
    ring = [r * F.cos(theta), r * F.sin(theta)]
    made = {
        "blobs": [blobs(j) for j in range(8)],
        "two_moons": [F.when(odd, _span(seed, f"ma{j}", at, -3, 3)).otherwise(moon[j] if j < 2 else 0.1 * _gauss(seed, f"mp{j}", at)) for j in range(6)],
        "ring": [F.when(odd, _span(seed, f"ra{j}", at, -1, 1)).otherwise(ring[j] if j < 2 else 0.05 * _gauss(seed, f"rp{j}", at)) for j in range(5)],
        "wide_variance": [F.when(odd, 3.0).otherwise(1.0) * _gauss(seed, f"w{j}", at) for j in range(20)],
        "local_dense": [F.when(odd, 4 + 0.1 * _gauss(seed, f"d{j}", at)).otherwise(_gauss(seed, f"d{j}", at)) for j in range(5)],
    }
    out = None
    for name, features in made.items():
        part_ = rows.select(F.lit(name).alias("dataset"), "row_id", F.array(*features).alias("features"), "y")
        out = part_ if out is None else out.unionAll(part_)
    return out


def series(spark: SparkSession, n: int = 10_000, seed: int = 0) -> DataFrame:
    """(series, pos, value, label): ten seasonal series with point spikes (4), noisy stretches (2), a trend, a threefold
    amplitude, a shifted frequency, and spikes mixed with noise."""
    pos = spark.range(n).withColumnRenamed("id", "pos")
    p = F.col("pos")

    def base(s: object) -> Column:
        return F.sin(2 * math.pi * p / 50) + 0.3 * F.sin(2 * math.pi * p / 17) + 0.1 * _gauss(s, "noise", p)

    def spikes(s: object, count: int) -> tuple[Column, Column]:
        hit = hash_uniform(s, "spike", p) < count / n
        sign = F.when(hash_uniform(s, "sign", p) < 0.5, -1.0).otherwise(1.0)
        return F.when(hit, sign * (3 + 2 * hash_uniform(s, "height", p))).otherwise(0.0), hit

    def stretches(s: object, count: int, length: int) -> tuple[Column, Column]:
        starts = [F.floor(hash_uniform(s, "start", F.lit(k)) * (n - length)) for k in range(count)]
        hit = F.lit(False)
        for a in starts:
            hit = hit | ((p >= a) & (p < a + length))
        return F.when(hit, 1.5 * _gauss(s, "burst", p)).otherwise(0.0), hit

    def segment(s: object, length: int) -> tuple[Column, Column]:
        a = F.floor(n / 3 + hash_uniform(s, "segment", F.lit(0)) * n / 3)
        return a, (p >= a) & (p < a + length)

    made: dict[str, tuple[Column, Column]] = {}
    for i, count in enumerate((40, 60, 80, 100)):
        add, hit = spikes(f"{seed}:p{i}", count)
        made[f"point_spikes_{i}"] = base(f"{seed}:p{i}") + add, hit
    for i, (count, length) in enumerate(((6, 120), (10, 80))):
        add, hit = stretches(f"{seed}:s{i}", count, length)
        made[f"noisy_stretch_{i}"] = base(f"{seed}:s{i}") + add, hit
    b = base(f"{seed}:o")
    a, hit = segment(f"{seed}:trend", 500)
    made["trend"] = F.when(hit, b + 3 * (p - a) / 499).otherwise(b), hit
    a, hit = segment(f"{seed}:amplitude", 400)
    made["amplitude"] = F.when(hit, 3 * b).otherwise(b), hit
    a, hit = segment(f"{seed}:frequency", 500)
    made["frequency_shift"] = F.when(hit, F.sin(2 * math.pi * (p - a) / 12) + 0.3 * F.sin(2 * math.pi * (p - a) / 5)).otherwise(b), hit
    x, h1 = spikes(f"{seed}:m", 30)
    y, h2 = stretches(f"{seed}:m", 4, 80)
    made["mixed"] = base(f"{seed}:m") + x + y, h1 | h2
    out = None
    for name, (value, hit) in made.items():
        part = pos.select(F.lit(name).alias("series"), "pos", value.alias("value"), hit.cast("int").alias("label"))
        out = part if out is None else out.unionAll(part)
    return out
