"""A persistent index of text digests: bucketed and sorted by digest, joined by sort-merge, appended to.

The index is a Parquet folder whose files are buckets of the digest, each sorted by it. New data are reduced to one row a
digest, a sort-merge anti-join against the index leaves the digests it does not hold, and these are appended. The index is
never shuffled: only the new side is, by the bucket's hash, so an append reads the index once and moves the new digests alone.
Texts are hashed where they lie and never shuffled. A folder can be opened again by another session.

DataFrame functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import store

#: White space as the contract has it, as a Java character class.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text_col: str) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACES, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest binary, row) of each row, stored: ``row`` tells repeated rows apart."""
    digest = F.unhex(F.sha2(normalised(text_col).cast("binary"), 256))
    return store.stash(docs.select(F.col(id_col).alias("id"), digest.alias("digest")).withColumn("row", F.monotonically_increasing_id()), "digests")


class DigestIndex:
    """(digest, keep_id, keep_row, batch): for each digest the row that came first, and the batch it came with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, kind: str) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id {kind}, keep_row BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    @classmethod
    def create(cls, spark: SparkSession, kind: str = "bigint", path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """An empty index of ids of SQL type ``kind``. ``buckets`` is for good: take as many as tasks of 128 MB of the index to come."""
        path = path or store.new_path(spark, "digest-index")
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.createDataFrame([(buckets, kind)], "buckets int, kind string").coalesce(1).write.json(f"{path}/_about")
        return cls(spark, path, buckets, kind)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DigestIndex:
        """The index that an earlier session left in ``path``."""
        about = spark.read.schema("buckets int, kind string").json(f"{path}/_about").first()
        return cls(spark, path, about.buckets, about.kind)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, rows: DataFrame) -> str:
        """Append the digests of ``rows`` (as ``digests`` gives them) that the index does not hold; returns the batch's name.

        Of equal digests in ``rows`` the one with the smallest id comes first, null ids last, and of repeated rows any one.
        What is new is stored before it is appended, so a lost executor costs tasks and never a second, different append.
        """
        batch = uuid.uuid4().hex
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("f")
        fresh = rows.groupBy("digest").agg(first).select("digest", "f.id", "f.row")
        fresh = fresh.hint("merge").join(self.read().select("digest"), "digest", "left_anti")
        fresh = store.stash(fresh.select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(batch).alias("batch")), "fresh-digests")
        with store.cleaned(self.spark):
            fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        store.drop_stash(fresh)
        return batch

    def compacted(self, path: str | None = None) -> DigestIndex:
        """The same index in a new folder, one sorted file a bucket: appends leave a file each."""
        kind = self.read().schema["keep_id"].dataType.simpleString()
        whole = DigestIndex.create(self.spark, kind, path, self.buckets)
        self.read().repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(whole.table)
        self.spark.catalog.refreshTable(whole.table)
        return whole

    def report(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """(id, keep_id, group_size, kept, digest) of each of ``rows``, whose digests the index holds.

        group_size counts equal texts in ``rows``; a row is kept if it is the one the index named when it came (in
        ``batch``, if that is given). A digest that a third of all rows share is counted and joined in as many parts as
        there are shuffle partitions, so no task holds it whole.
        """
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
        counts = dealt.groupBy("digest", "part").agg(F.count(F.lit(1)).alias("n"))
        sizes = counts.groupBy("digest").agg(F.sum("n").alias("group_size"))
        known = sizes.hint("merge").join(self.read(), "digest")
        named = counts.drop("n").join(known, "digest")
        kept = F.col("row") == F.col("keep_row")
        if batch is not None:
            kept &= F.col("batch") == batch
        return dealt.join(named, ["digest", "part"]).select("id", "keep_id", "group_size", kept.alias("kept"), "digest")


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is new to ``index``, one of each text; the index then holds them.

    A null text is an empty one; of equal texts the smallest id stays, null ids last, and of repeated rows one; an empty table
    adds nothing; other columns, of any name, are kept as they are.
    """
    rows = digests(docs, id_col, text_col)
    batch = index.add(rows)
    new = index.read().where(F.col("batch") == batch).select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"))
    digest = F.unhex(F.sha2(normalised(text_col).cast("binary"), 256))
    mine = docs.withColumn("__digest", digest).withColumn("__id", F.col(id_col)).join(new, "__digest").where(F.col("__id").eqNullSafe(F.col("__keep")))
    return mine.dropDuplicates(["__digest"]).select(*docs.columns)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) of each row, through a new index that takes the rows in two arrivals.

    The lower half of the ids comes first, then the rest and null ids, so that the smallest id of a text is the one that
    stays. A null text is an empty one; repeated rows count each and one of them is kept; an empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = digests(docs, id_col, text_col)
    index = index or DigestIndex.create(spark, docs.schema[id_col].dataType.simpleString())
    middle = rows.agg(F.percentile_approx("id", 0.5)).first()[0]
    early = F.coalesce(F.col("id") <= F.lit(middle), F.lit(False))
    index.add(rows.where(early))
    index.add(rows.where(~early))
    return index.report(rows)
