"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import chunk_dedup, decontaminate, digest_index, elias_fano, hard_negatives, line_quality, lm, packing, pii, simhash, spelling, suffix_dedup, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select(F.col("id").alias("doc_id"), simhash.fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(split(base, ','), s -> startswith(s, '{k}:'))) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = elias_fano.write_shards(_table(spark, sf_dir, "documents"), tokens.default_path(), end=2)
    return elias_fano.read_shards(manifest)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(_table(spark, sf_dir, "documents")).drop("removed_words").withColumnRenamed("id", "doc_id")


def op7_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(_table(spark, sf_dir, "documents"), tokens.default_path(), capacity=4096, end=1)
    return packing.pack(pieces, capacity=4096)


def op8_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    machine, chosen = toxicity.fit(docs, _table(spark, sf_dir, "labels"), learn=~held)
    scored = toxicity.score(docs.select("doc_id", "text"), machine, chosen)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunk_dedup.dedup(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "first_ids")


def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", F.round("similarity", 6).alias("similarity"), "first_word")


def op11_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = digest_index.exact_groups(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_trie_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), corrupt=97)


def op13_anchor_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.rows_of(_table(spark, sf_dir, "embeddings"), flip=7)
    return hard_negatives.mine(rows, rows.where("id % 100 = 0"))


_ALL = (
    op1_simhash_near_dedup,
    op2_maxent_lm,
    op3_crf_pii,
    op4_elias_fano_tokens,
    op5_suffix_dedup,
    op6_line_quality,
    op7_genetic_packing,
    op8_fm_toxicity,
    op9_gear_chunk_dedup,
    op10_simhash_decontamination,
    op11_digest_index,
    op12_trie_spelling,
    op13_anchor_tree_negatives,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(greatest(length(x) // 2 - 49, 0))) AS i FROM d),
s AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS w FROM p),
m AS (SELECT w, min(doc_id) AS lo FROM s GROUP BY w),
c AS (SELECT s.doc_id, i FROM s JOIN m USING (w) WHERE lo < s.doc_id),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c),
k AS (SELECT *, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM g),
e AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY doc_id, r),
f AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM e),
t AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(x, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) AS kept FROM f JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM h, range(3) q(j) GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n_words, sum(length(x)) AS word_chars FROM u GROUP BY doc_id),
l AS (SELECT doc_id, host, t, l FROM (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
k AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM l GROUP BY doc_id),
n AS (SELECT doc_id, host, t, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS l FROM l),
c AS (SELECT host, l FROM n GROUP BY host, l HAVING count(DISTINCT {'d': doc_id, 't': md5(t)}) > 5),
x AS (SELECT doc_id, sum(1 + length(l) - length(replace(l, ' ', ''))) AS n FROM n JOIN c USING (host, l) GROUP BY doc_id),
s AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(k.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(x.n, 0) AS gone
  FROM d LEFT JOIN a USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND gone <= n_words * 0.2 AS kept FROM s
"""

_OP11 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

_OP13 = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score FROM r a, r WHERE a.id % 100 = 0 AND a.id <> r.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10
"""

#: The others hash, train, tokenize or iterate, which SQL cannot express: ``tests/llm`` holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op5_suffix_dedup": _OP5, "op6_line_quality": _OP6, "op11_digest_index": _OP11, "op13_anchor_tree_negatives": _OP13}
