"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, contaminated documents go, personal data
is redacted, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; ``run`` writes each stage's result as Parquet into
the cluster's shared folder and gives it to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import decontaminate, near_dedup, packing, pii, store, tokens, toxicity

#: SQL cannot express hashing, training and packing; ``tests/llm`` holds the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below 0.3. Labels of the held-out quarter are not learned."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    machine, chosen = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=~held)
    return toxicity.score(docs, machine, chosen, out_col="__toxicity").where("__toxicity < 0.3").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the text replaced by its kind and n_chars counted anew."""
    return pii.redacted(docs, length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token pieces packed into sequences of 4096."""
    return packing.pack(packing.cut(docs, tokens.default_path(), capacity=4096, end=1), capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = store.stash(stage(spark, docs, sf_dir), f"stage{k + 1}")
    return docs
