"""Toxicity by a factorization machine (Rendle, 2010) over hashed terms.

Terms are words (letters, digits and non-ASCII bytes, ASCII lower-cased) and the first 3 to 8 bytes of words, hashed into
2**20 buckets; a document holds each bucket once or not. The machine adds to the linear weights an inner product of
factors for each pair of terms a document holds, so that a term can count for more beside another.

The classifier is fitted on a bounded sample: at most ``fit_rows`` labelled documents in the order of a hash of their id,
and the ``n_terms`` buckets whose log-odds differ most from chance in that sample. Scoring covers every row, whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm import text

BUCKET_BITS = 20
PREFIXES = (3, 4, 5, 6, 7, 8)

_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[48:58] = _IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True


def terms(column: pa.Array, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every term, each pair once; with ``chosen`` (a number for each bucket, or -1) (row, number) of those chosen."""
    data, offsets = text.raw(column)
    data = text.LOWER[data]
    starts, ends, row = text.spans(data, offsets, _IN_TERM)
    keys = []
    for k in (None, *PREFIXES):
        which = slice(None) if k is None else np.flatnonzero(ends - starts > k)
        h = text.hashes(data, starts[which], ends[which] if k is None else starts[which] + k)
        h = text.mix(h + np.uint64(0 if k is None else k)) >> np.uint64(64 - BUCKET_BITS)
        own = row[which]
        if chosen is not None:
            number = chosen[h.astype(np.int64)]
            hit = number >= 0
            own, h = own[hit], number[hit].astype(np.uint64)
        keys.append((own.astype(np.uint64) << np.uint64(BUCKET_BITS)) | h)
    both = np.unique(np.concatenate(keys))
    return (both >> np.uint64(BUCKET_BITS)).astype(np.int64), (both & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)


class Machine:
    """Bias, linear weights and factors over ``n`` chosen terms."""

    def __init__(self, n: int, factors: int = 8, seed: int = 3) -> None:
        self.bias, self.linear = 0.0, np.zeros(n)
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (n, factors))

    def raw(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """Log-odds of rows given as (row, term) pairs."""
        out = self.bias + np.bincount(row, self.linear[term], rows)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            out += 0.5 * (np.bincount(row, v, rows) ** 2 - np.bincount(row, v * v, rows))
        return out

    def fit(self, row: np.ndarray, term: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 150, rate: float = 0.05, decay: float = 2e-3) -> None:
        """Adam on the weighted logistic loss with an L2 penalty, full batches."""
        rows, total = len(y), max(1e-9, float(weight.sum()))
        rate0 = float((weight * y).sum() / total)
        self.bias = float(np.log((rate0 + 1e-3) / (1 - rate0 + 1e-3)))
        params = [np.array([self.bias]), self.linear, self.factors]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        n, k = self.factors.shape
        for step in range(1, rounds + 1):
            out = params[0][0] + np.bincount(row, params[1][term], rows)
            sums = np.stack([np.bincount(row, params[2][term, f], rows) for f in range(k)], axis=1) if n else np.zeros((rows, k))
            squares = np.bincount(row, (params[2][term] ** 2).sum(axis=1), rows)
            out += 0.5 * ((sums**2).sum(axis=1) - squares)
            rest = weight * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / total
            grads = [np.array([rest.sum()]), np.bincount(term, rest[row], n) + decay * params[1] / max(1, n), None]
            inner = rest[row][:, None] * (sums[row] - params[2][term])
            grads[2] = np.stack([np.bincount(term, inner[:, f], n) for f in range(k)], axis=1) + decay * params[2] / max(1, n)
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        self.bias, self.linear, self.factors = float(params[0][0]), params[1], params[2]


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column, fit_rows: int) -> DataFrame:
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learn)
    sample = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    # at most fit_rows small rows, so the whole side may be broadcast
    rows = text.bounded(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(learn if id_col == "_id" else F.lit(True))
    return rows.join(F.broadcast(sample), "_id").select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None, fit_rows: int = 24_000, n_terms: int = 768) -> tuple[Machine, np.ndarray]:
    """The machine and the number of each bucket (-1: not a term). ``learn`` says which labels may be used.

    Without any usable label the machine has no terms and scores every text alike.
    """
    sample = _labelled(docs, labels, id_col, text_col, label_col, F.lit(True) if learn is None else learn, fit_rows)

    def counted(batches):
        for b in text.pieces(batches, "text"):
            y = b.column("y").to_numpy(zero_copy_only=False)
            row, bucket = terms(b.column("text"))
            pos = np.bincount(bucket, y[row] > 0, 1 << BUCKET_BITS)
            each = np.bincount(bucket, minlength=1 << BUCKET_BITS)
            at = np.flatnonzero(each)
            yield pa.RecordBatch.from_pydict({"bucket": np.append(at, -1), "pos": np.append(pos[at], (y > 0).sum()).astype(np.int64), "n": np.append(each[at], len(y)).astype(np.int64)})

    counts = sample.mapInArrow(counted, "bucket bigint, pos bigint, n bigint").groupBy("bucket").agg(F.sum("pos").alias("p"), F.sum("n").alias("n"))
    counts = counts.persist()
    total = counts.where("bucket = -1").select("p", "n").first() or (0, 0)
    p_all, n_all = int(total[0] or 0), int(total[1] or 0)
    least = max(3, p_all // 250)
    odds = f"ln((p + 0.5D) / ({p_all} - p + 0.5D)) - ln((n - p + 0.5D) / ({n_all - p_all} - n + p + 0.5D))"
    z = F.expr(f"({odds}) / sqrt(1 / (p + 0.5D) + 1 / (n - p + 0.5D))")
    best = counts.where(f"bucket >= 0 AND n >= {least}").withColumn("z", F.abs(z)).where("z >= 3").orderBy(F.desc("z"), "bucket").limit(n_terms).select("bucket").collect()
    counts.unpersist()
    chosen = np.full(1 << BUCKET_BITS, -1, np.int16)
    chosen[[r[0] for r in best]] = np.arange(len(best), dtype=np.int16)

    def held(batches):
        for b in text.pieces(batches, "text"):
            row, number = terms(b.column("text"), chosen)
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(number, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("y"), lists], ["y", "t"])

    # rows that look the same are one row with a weight; the sample is bounded, and so is what is fetched
    patterns = sample.mapInArrow(held, "y int, t array<int>").groupBy("y", "t").count().orderBy(F.desc("count"), "y", "t").limit(2 * fit_rows).toArrow()
    machine = Machine(len(best))
    if patterns.num_rows:
        lists = patterns.column("t").combine_chunks()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        machine.fit(row, lists.values.to_numpy()[lists.offsets[0].as_py() :].astype(np.int64), (patterns.column("y").to_numpy() > 0).astype(float), patterns.column("count").to_numpy().astype(float))
    return machine, chosen


def score(docs: DataFrame, machine: Machine, chosen: np.ndarray, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score of 0 to 1 for each row, in one pass without a shuffle. Null and empty texts hold no term.

    A column that already has the name of the new one is replaced.
    """
    base = text.bounded(docs).drop(out_col)
    names = base.columns
    fields = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in names)

    def run(batches):
        for whole in batches:
            kept = whole.column(names.index(text_col))
            done = 0
            for b in text.pieces(iter([whole]), text_col):
                row, number = terms(b.column(names.index(text_col)), chosen)
                p = 1 / (1 + np.exp(-np.clip(machine.raw(row, number, b.num_rows), -30, 30)))
                cols = [kept.slice(done, b.num_rows) if c == text_col else b.column(k) for k, c in enumerate(names)]
                done += b.num_rows
                yield pa.RecordBatch.from_arrays([*cols, pa.array(p)], [*names, out_col])

    return base.mapInArrow(run, f"{fields}, `{out_col}` double")
