"""Readers of array and archive files, and resumable sinks. Files are listed and split by Spark; each is decoded by one task."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABULAR = "dataset string, corpus string, origin_split string, row_id bigint, features array<double>, y int"
SERIES = "series string, source string, pos bigint, value double, label int"
CHANNELS = "series string, source string, pos bigint, channel int, value double, label int"


def _finite(x: np.ndarray) -> np.ndarray:
    return np.nan_to_num(np.asarray(x, float), nan=0.0, posinf=0.0, neginf=0.0)


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def read_npz(spark: SparkSession, path: str, corpus: str = "", least: int = 200, most: int = 50_000) -> DataFrame:
    """Arrays X and y, or train and test with their labels (pooled, origin kept); files of other sizes are skipped."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    if "X" in z:
                        x, y, split = z["X"], z["y"], np.full(len(z["X"]), "")
                    else:
                        x = np.vstack([z["train"], z["test"]])
                        y = np.concatenate([z["train_labels"], z["test_labels"]])
                        split = np.repeat(["train", "test"], [len(z["train"]), len(z["test"])])
                if least <= len(x) <= most:
                    x = _finite(x)
                    yield pd.DataFrame({"dataset": _name(file), "corpus": corpus, "origin_split": split, "row_id": np.arange(len(x)), "features": list(x), "y": np.asarray(y).astype(int).ravel()})

    return _binary(spark, path, "*.npz").mapInPandas(decode, TABULAR)


def preferred_member(names: list[str]) -> str | None:
    """Of an archive's .arff members: without duplicates first, then normalised, no replicate, least share of outliers."""

    def order(name: str) -> tuple:
        base = name.rsplit("/", 1)[-1]
        share = re.search(r"_(\d{2})(?:_v\d+)?\.arff$", base)
        return ("withoutdupl" not in base, "_norm" not in base, re.search(r"_v\d+\.arff$", base) is not None, int(share[1]) if share else 99, name)

    found = [n for n in names if n.endswith(".arff")]
    return min(found, key=order) if found else None


def parse_arff(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels): numeric attributes without id; the label is attribute outlier, yes or no."""
    names, rows, in_data = [], [], False
    for line in text.splitlines():
        s = line.strip()
        if not s or s.startswith("%"):
            continue
        if in_data:
            rows.append([v.strip().strip("'\"") for v in s.split(",")])
        elif s.lower().startswith("@attribute"):
            names.append(re.split(r"\s+", s, maxsplit=2)[1].strip("'\"").lower())
        elif s.lower().startswith("@data"):
            in_data = True
    label = names.index("outlier")
    keep = [i for i, n in enumerate(names) if n not in ("outlier", "id")]
    x = np.array([[float(r[i]) if r[i] not in ("?", "") else np.nan for i in keep] for r in rows], float).reshape(len(rows), len(keep))
    return x, np.array([int(r[label].lower() == "yes") for r in rows], int)


def read_arff_archives(spark: SparkSession, path: str, corpus: str = "") -> DataFrame:
    """One preferred member of each .tar.gz."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    member = preferred_member(tar.getnames())
                    if member is None:
                        continue
                    x, y = parse_arff(tar.extractfile(member).read().decode("utf-8", "replace"))
                yield pd.DataFrame({"dataset": _name(_name(file)), "corpus": corpus, "origin_split": "", "row_id": np.arange(len(x)), "features": list(_finite(x)), "y": y})

    return _binary(spark, path, "*.tar.gz").mapInPandas(decode, TABULAR)


def _members(spark: SparkSession, path: str, pattern: str, most: int | None) -> DataFrame:
    """(file, member): archive members in the order of the SHA-1 of their name, at most ``most`` in all."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [n for n in z.namelist() if re.search(pattern, n, re.IGNORECASE)]
                yield pd.DataFrame({"path": file, "member": found}, dtype=str)

    listed = _binary(spark, path, "*.zip").mapInPandas(names, "path string, member string")
    return listed.orderBy(F.sha1("member"), "member").limit(most) if most else listed


def _decoded(spark: SparkSession, path: str, members: DataFrame, schema: str, parse) -> DataFrame:
    """Each archive is opened once, for all its chosen members."""
    wanted = members.groupBy("path").agg(F.sort_array(F.collect_list("member")).alias("members"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content, chosen in zip(pdf["content"], pdf["members"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in chosen:
                        out = parse(member, z.read(member))
                        if out is not None:
                            yield out

    return _binary(spark, path, "*.zip").join(wanted, "path").mapInPandas(decode, schema)


def _source(member: str) -> str:
    parts = member.rsplit("/", 1)[-1].split("_")
    return parts[1] if len(parts) > 1 else "?"


def read_series_csv(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Zipped CSV files of value and label columns."""

    def parse(member: str, data: bytes) -> pd.DataFrame | None:
        try:
            df = pd.read_csv(io.BytesIO(data))
            x, y = _finite(df.iloc[:, 0]), df.iloc[:, 1].to_numpy(int)
        except (ValueError, IndexError):
            return None
        return pd.DataFrame({"series": member.rsplit("/", 1)[-1], "source": _source(member), "pos": np.arange(len(x)), "value": x, "label": y})

    return _decoded(spark, path, _members(spark, path, r"\.csv$", most), SERIES, parse)


def read_series_text(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Zipped text files of one value a line; the name ends in trainEnd_anomalyStart_anomalyEnd.txt, ends included."""
    named = re.compile(r"_(\d+)_(\d+)_(\d+)\.txt$", re.IGNORECASE)

    def parse(member: str, data: bytes) -> pd.DataFrame | None:
        m = named.search(member)
        try:
            x = np.array(data.decode("utf-8", "replace").split(), float)
        except ValueError:
            return None
        pos = np.arange(len(x))
        return pd.DataFrame({"series": member.rsplit("/", 1)[-1], "source": "text", "pos": pos, "value": x, "label": ((pos >= int(m[2])) & (pos <= int(m[3]))).astype(int)})

    return _decoded(spark, path, _members(spark, path, named.pattern, most), SERIES, parse)


def read_channels_csv(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Zipped CSV files of several channels and a label column (label, is_anomaly or anomaly), one row for each channel."""

    def parse(member: str, data: bytes) -> pd.DataFrame | None:
        try:
            df = pd.read_csv(io.BytesIO(data))
        except ValueError:
            return None
        label = [c for c in df.columns if c.lower() in ("label", "is_anomaly", "anomaly")]
        if not label:
            return None
        x, y = _finite(df.drop(columns=label)), df[label[0]].to_numpy(int)
        n, c = x.shape
        return pd.DataFrame({"series": member.rsplit("/", 1)[-1], "source": _source(member), "pos": np.repeat(np.arange(n), c), "channel": np.tile(np.arange(c), n), "value": x.ravel(), "label": np.repeat(y, c)})

    return _decoded(spark, path, _members(spark, path, r"\.csv$", most), CHANNELS, parse)


# --- tables and sinks -------------------------------------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def require_columns(df: DataFrame, columns: set[str], name: str = "input") -> DataFrame:
    """``df`` if it has the columns, else an error that names those missing."""
    missing = sorted(columns - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df


def missing_arms(found: list[str], wanted: list[str]) -> list[str]:
    return [w for w in wanted if w not in set(found)]


def append_results(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the folder does not have yet, as JSON lines; returns how many. A job that stops can be
    run again: what is done is an anti-join."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        df = df.join(spark.read.schema(df.schema).json(path).select(*keys).distinct(), keys, "left_anti")
    df = df.persist()
    n = df.count()
    if n:
        df.write.mode("append").json(path)
    df.unpersist()
    return n


def replace_parts(df: DataFrame, path: str, by: str) -> None:
    """Write one folder for each value of ``by``, replacing only those in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def score_matrix(scores: DataFrame, path: str) -> None:
    """Long score rows (dataset, split, row_id, variant, score, y), partitioned by data set."""
    scores.select("dataset", "split", "row_id", "variant", F.col("score").cast("float").alias("score"), F.col("y").cast("tinyint").alias("y")).write.mode("overwrite").partitionBy("dataset").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(key, detector, ap, a1) of JSON lines {"key": ..., "ap": {detector: value}, "a1": {detector: value}}."""
    r = spark.read.schema("key string, ap map<string,double>, a1 map<string,double>").json(path)
    return r.select("key", "a1", F.explode("ap").alias("detector", "ap")).select("key", "detector", "ap", F.col("a1")[F.col("detector")].alias("a1"))


def read_nested_results(spark: SparkSession, path: str) -> DataFrame:
    """(tag, key, rep, mode, k, prevalence, method, metric, value) of nested result maps."""
    r = spark.read.schema("tag string, key string, rep int, mode string, k int, res map<string,map<string,array<double>>>").json(path)
    e = r.select("tag", "key", "rep", "mode", "k", F.explode("res").alias("prevalence", "m")).select("tag", "key", "rep", "mode", "k", "prevalence", F.explode("m").alias("method", "v"))
    return e.select("tag", "key", "rep", "mode", "k", "prevalence", "method", F.posexplode("v").alias("metric", "value"))
