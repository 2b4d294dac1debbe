"""Quality rules with DataFrame functions only: repetition inside a document, and lines that many documents of a host share.

Cross-document line frequency: lines are lower-cased, white space in them is collapsed, and each is hashed. For each host, the
distinct documents that hold a line are counted; a document is an id with a text, so a repeated row counts once and copies
under several ids count each. Lines held by more than ``MIN_DOCS`` documents of a host are removed, whatever the host's size.
A document that loses more than ``MAX_GONE`` of its words to removed lines is rejected as depleted.

The text is read once; later steps work on a stored table of hashes and counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import store

#: White space as the contract has it, as a Java character class.
SPACES = r"[\\x20\\x09-\\x0D]"

MIN_DOCS = 5
MAX_GONE = 0.2


def _statistics(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(text_col, F.lit("")).alias("t"))
    one = t.select(
        "id",
        "host",
        F.unhex(F.md5("t")).alias("digest"),
        F.expr(f"array_remove(split(t, '{SPACES}+'), '')").alias("w"),
        F.expr("cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '')) as bigint)").alias("n_symbols"),
        F.expr(f"filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"),
    )
    two = one.select(
        "id",
        "host",
        "digest",
        "n_symbols",
        F.expr("cast(size(w) as bigint)").alias("n_words"),
        F.expr("cast(length(array_join(w, '')) as bigint)").alias("word_chars"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr("CASE WHEN size(w) < 3 THEN cast(array() as array<bigint>) ELSE transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END").alias("h"),
        F.expr(f"transform(lines, l -> lower(regexp_replace(l, '{SPACES}+', ' ')))").alias("lines"),
    )
    three = two.withColumn("s", F.sort_array("h")).withColumn("lines", F.expr("transform(transform(lines, l -> trim(l)), l -> struct(xxhash64(l) AS h, 1 + length(l) - length(replace(l, ' ', '')) AS n))"))
    four = three.withColumn("d", F.expr("array_distinct(filter(s, (x, i) -> i > 0 AND x = s[i - 1]))")).drop("s")
    # positions of repeated windows: a few repeated hashes are looked up; many are found by sorting hashes with positions
    five = four.withColumn("z", F.expr("CASE WHEN size(d) > 6 THEN array_sort(transform(h, (x, i) -> struct(x AS x, i AS i))) END"))
    places = """CASE WHEN size(d) = 0 THEN cast(array() as array<int>)
        WHEN size(d) <= 6 THEN filter(sequence(0, size(h) - 1), i -> array_contains(d, h[i]))
        ELSE sort_array(transform(filter(z, (y, i) -> y.x = z[greatest(i - 1, 0)].x AND i > 0 OR i < size(z) - 1 AND y.x = z[least(i + 1, size(z) - 1)].x), y -> y.i)) END"""
    six = five.withColumn("p", F.expr(places)).drop("d", "h", "z")
    covered = "aggregate(p, struct(0L AS n, 0 AS e), (a, i) -> struct(a.n + cast(i + 3 - greatest(i, a.e) AS bigint) AS n, i + 3 AS e), a -> a.n)"
    return six.select("id", "host", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(covered).alias("n_repeat_words"), "lines")


def _removed_lines(rows: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(host, digest, h, n): the lines of each text with their words in all, and (host, h): the lines to be removed.

    Copies of a text in a host are one row from the start, with the number of its documents, so that a text or line that a
    third of all documents hold is combined before it is shuffled.
    """
    texts = rows.groupBy("host", "digest").agg(F.any_value("lines").alias("lines"), F.countDistinct(F.struct("id")).alias("docs"))
    lines = texts.select("host", "digest", "docs", F.explode("lines").alias("l")).groupBy("host", "digest", F.col("l.h").alias("h")).agg(F.sum("l.n").alias("n"), F.first("docs").alias("docs"))
    common = lines.groupBy("host", "h").agg(F.sum("docs").alias("held")).where(F.col("held") > min_docs).select("host", "h")
    return lines, common


def _verdicts(rows: DataFrame, lines: DataFrame, common: DataFrame, max_gone: float) -> DataFrame:
    removed = lines.join(common, ["host", "h"]).groupBy("host", "digest").agg(F.sum("n").alias("removed_words"), F.collect_set("h").alias("gone"))
    out = rows.drop("lines").join(removed, ["host", "digest"], "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    words = F.coalesce("removed_words", F.lit(0)).cast("bigint")
    return out.withColumn("base_failed", failed).withColumn("removed_words", words).withColumn("kept", ~failed & (words <= F.col("n_words") * max_gone))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_gone: float = MAX_GONE) -> DataFrame:
    """(id, counts, base_failed, removed_words, kept) for each row.

    A null text has no words and fails; a null host is a host of its own; rows with a null id and one text are one document;
    repeated rows get the same verdict each; an empty table gives an empty result; other columns are not read.
    """
    rows = store.stash(_statistics(docs, id_col, text_col, host_col), "lines")
    found = _verdicts(rows, *_removed_lines(rows, min_docs), max_gone)
    return found.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_gone: float = MAX_GONE) -> DataFrame:
    """The rows that are kept, all columns, with their text less its removed lines; rules and cases as in ``judge``."""
    rows = store.stash(_statistics(docs, id_col, text_col, host_col), "lines")
    found = _verdicts(rows, *_removed_lines(rows, min_docs), max_gone).where("kept")
    found = found.groupBy(F.col("host").alias("__host"), F.col("digest").alias("__digest")).agg(F.any_value("gone").alias("__gone"))
    host, body = F.coalesce(F.col(host_col).cast("string"), F.lit("")), F.coalesce(text_col, F.lit(""))
    named = docs.withColumn("__host", host).withColumn("__digest", F.unhex(F.md5(body)))
    normal = f"lower(trim(regexp_replace(l, '{SPACES}+', ' ')))"
    left = F.expr(f"CASE WHEN size(__gone) > 0 THEN array_join(filter(split(`{text_col}`, '\\n'), l -> NOT array_contains(__gone, xxhash64({normal}))), '\n') ELSE `{text_col}` END")
    return named.join(found, ["__host", "__digest"]).withColumn(text_col, left).select(*docs.columns)
