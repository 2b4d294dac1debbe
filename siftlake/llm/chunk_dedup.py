"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash adds a drawn number for each byte to twice the hash before, so its 32 bits depend on the last 32 bytes alone;
it is computed for a whole batch by five doubling steps. A chunk ends after a byte whose hash has its top bits zero, once
the chunk has ``SHORTEST`` bytes; an unfinished tail shorter than that joins the chunk before it. Since cuts follow the
content, an insertion moves cuts only near itself. Chunks are compared by 128-bit digests, and every chunk but the first
with its digest, in the order of (id, position), is removed. A document is an id with a text: different texts under one id are
told apart, and rows that repeat both are one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import store, text

SHORTEST = 32
CUT_BITS = 5  #: a chunk is about SHORTEST + 2**CUT_BITS bytes long

GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    return h


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Where the chunks of one text end."""
    if not len(data):
        return np.zeros(0, np.int64)
    cuts = (np.flatnonzero(gear(data) >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    ends, last = [], 0
    for c in cuts:
        if c - last >= SHORTEST:
            ends.append(c)
            last = c
    if last < len(data):
        if ends and len(data) - last < SHORTEST:
            ends.pop()
        ends.append(len(data))
    return np.array(ends, np.int64)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(hi, lo, id, text_hash, start, length): every chunk of every row with an id, with its digest in two halves."""

    def run(batches):
        for b in text.pieces(batches, "text"):
            data, offsets = text.raw(b.column("text"))
            view = memoryview(np.ascontiguousarray(data)).cast("B")
            row, start, length, digest = [], [], [], []
            for r, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                ends = chunk_ends(data[a:z])
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
                row.append(np.full(len(ends), r))
                start.append(starts)
                length.append(ends - starts)
                digest.extend(hashlib.blake2b(view[a + s : a + e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True))
            if digest:
                halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), *(b.column(c).take(pa.array(np.concatenate(row))) for c in ("id", "text_hash")), pa.array(np.concatenate(start)), pa.array(np.concatenate(length))], ["hi", "lo", "id", "text_hash", "start", "length"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _rows(docs, id_col, text_col).where("id IS NOT NULL").mapInArrow(run, f"hi bigint, lo bigint, id {kind}, text_hash bigint, start bigint, length bigint")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col), F.lit(""))
    return text.bounded(docs).select(F.col(id_col).alias("id"), body.alias("text"), F.xxhash64(body).alias("text_hash"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, start, length, first_id): each chunk that an earlier one equals, and the document of the first such chunk.

    The order is id, then position; of texts under one id, that with the smaller hash comes first at equal positions. Rows
    without an id have no place in the order and are left out. Every digest's first chunk is an aggregate that combines before
    the shuffle, so a chunk that a third of all documents hold is no hot key; the join back may split it.
    """
    found = store.stash(chunks(docs, id_col, text_col), "chunks")
    place = F.struct("id", "start", "text_hash")
    first = found.groupBy("hi", "lo").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1").select("hi", "lo", "f")
    back = found.join(first, ["hi", "lo"])
    return back.where(place != F.col("f")).select("id", "text_hash", "start", "length", F.col("f.id").alias("first_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, first_ids) for each row.

    kept is the text without repeated chunks, as bytes, for a cut may fall inside a character; first_ids lists the
    documents that hold the first copies. A null text is empty. Rows that repeat id and text lose the same; different texts
    under one id lose what each repeats; a row without an id is kept whole. Ids may be of any type that has an order.
    """
    gone = repeats(docs, id_col, text_col)
    per_doc = gone.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("gone"), F.array_sort(F.collect_set("first_id")).alias("first_ids"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _rows(docs, id_col, text_col).join(per_doc, ["id", "text_hash"], "left")

    def run(batches):
        for b in batches:
            names = b.schema.names
            ids, texts, lists, firsts = (b.column(names.index(c)) for c in ("id", "text", "gone", "first_ids"))
            out = []
            for t, own in zip(texts, lists.to_pylist(), strict=True):
                data, kept, last, spans, removed = t.as_buffer().to_pybytes(), [], 0, 0, 0
                ends = -1
                for s in own or []:
                    a, z = s["start"], s["start"] + s["length"]
                    kept.append(data[last:a])
                    spans += a != ends
                    removed += z - a
                    last = ends = z
                out.append((len(data), removed, spans, b"".join([*kept, data[last:]])))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary()), firsts], ["id", "n_bytes", "n_removed", "n_spans", "kept", "first_ids"])

    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, first_ids array<{kind}>")
