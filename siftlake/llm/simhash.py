"""SimHash fingerprints and all pairs within a Hamming radius by the pigeonring principle (Qin and Xiao, 2018).

A 64-bit fingerprint is cut into ``m`` segments on a ring. If two fingerprints differ in at most ``r`` bits, some
segment starts a chain whose every prefix of ``l`` segments differs in at most ``l * r / m`` bits. The first ``key_chain``
segments of that chain are the join key: one side keeps its own bits, the other lists all variants within the prefix
budgets. The join condition then asks for the longer prefixes and the whole distance, so pairs that fail are never rows.

Identical fingerprints are one class from the start: only distinct fingerprints are joined, copies are members.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.llm import store, text
from siftlake.llm.components import components

SEED = 42


def _bits(h: list[int] | np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, from the highest."""
    a = np.asarray(h, dtype=">u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(a), 1 << 15):
        part = a[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """Majority bits of XXH64 over all space-joined shingles, repeats included; ``shingle`` 0 takes the distinct words.

    Fewer words than ``shingle`` are one shingle; no word gives zero.
    """
    if not words:
        return 0
    x = xxhash.xxh64_intdigest
    if shingle == 0:
        h = [x(w, SEED) for w in set(words)]
    elif len(words) <= shingle:
        h = [x(b" ".join(words), SEED)]
    else:
        h = [x(b, SEED) for b in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]
    return int.from_bytes(np.packbits(_bits(h) * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp bigint) for each row, a null text as empty. One pass without a shuffle."""

    def run(batches):
        for b in text.pieces(batches, "text"):
            fps = [fingerprint(t.as_buffer().to_pybytes().lower().split(), shingle) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text.bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def _cuts(m: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    ends = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _long(x: int) -> str:
    """A 64-bit pattern as a SQL literal."""
    x = x - (1 << 64) if x >= 1 << 63 else x
    return f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"


def ring_pairs(points: DataFrame, radius: int, segments: int, key_chain: int = 1, also: str = "true", extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b) of points (id bigint, fp bigint) whose fingerprints differ in at most ``radius`` bits, each pair once.

    Ids are distinct. ``also`` is a symmetric SQL condition on x.<extra> and y.<extra>. No pair is missed: each chain start
    is a key of its own.
    """
    cuts, m = _cuts(segments), segments
    budget = [length * radius // m for length in range(m + 1)]
    own, probe = [], []
    for i in range(m):
        chain = [cuts[(i + k) % m] for k in range(m)]
        held = sum(((1 << w) - 1) << s for s, w in chain[:key_chain])
        masks = [0]
        for n in range(1, budget[key_chain] + 1):
            for where in combinations([s + b for s, w in chain[:key_chain] for b in range(w)], n):
                inside = [sum(s <= b < s + w for b in where) for s, w in chain[:key_chain]]
                if all(sum(inside[: k + 1]) <= budget[k + 1] for k in range(key_chain)):
                    masks.append(sum(1 << b for b in where))
        key = f"(fp & {_long(held)})"
        own.append(f"struct({i} AS i, {key} AS k)")
        listed, low = ("array(" + ",".join(map(_long, x)) + ")" for x in (masks, [e & -e for e in masks]))
        # of two ends, the one whose lowest differing bit is 0 lists the other's key
        probe.append(f"transform(filter({listed}, (e, j) -> ({key} & {low}[j]) = 0L), e -> struct({i} AS i, {key} ^ e AS k))")
    left = points.select("id", "fp", *extra, F.explode(F.expr(f"array({','.join(own)})")).alias("z")).select("id", "fp", *extra, "z.*")
    right = points.select("id", "fp", *extra, F.explode(F.expr(f"concat({','.join(probe)})")).alias("z")).select("id", "fp", *extra, "z.*")
    differ = "(x.fp ^ y.fp)"
    chains = []
    for i in range(m):
        chain = [cuts[(i + k) % m] for k in range(m)]
        held, tests = 0, []
        for k, (s, w) in enumerate(chain[:-1]):
            held |= ((1 << w) - 1) << s
            if k + 1 > key_chain or (k + 1 == 1 and key_chain > 1):
                tests.append(f"bit_count({differ} & {_long(held)}) <= {budget[k + 1]}")
        if tests:
            chains.append(f"(x.i <> {i} OR ({' AND '.join(tests)}))")
    near = " AND ".join([f"bit_count({differ}) <= {radius}", *chains])
    # equal keys: each pair once, from the smaller id; keys that differ are listed by one end only
    keys = [sum(((1 << w) - 1) << s for s, w in (cuts[(i + k) % m] for k in range(key_chain))) for i in range(m)]
    once = " OR ".join(f"(x.i = {i} AND ({differ} & {_long(held)}) <> 0L)" for i, held in enumerate(keys)) if budget[key_chain] else "false"
    on = f"x.i = y.i AND x.k = y.k AND x.id <> y.id AND (x.id < y.id OR {once}) AND {near} AND {also}"
    # the planner sizes a listing like the points it comes from, tens of times too low: without the hint it may be broadcast
    found = left.hint("merge").alias("x").join(right.hint("merge").alias("y"), F.expr(on))
    return found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def ring_test(differ: str, radius: int, segments: int) -> str:
    """SQL: whether the differing bits hold a chain of segments around the ring whose every prefix is within its share."""
    cuts = _cuts(segments)
    chains = []
    for i in range(segments):
        held, tests = 0, []
        for k in range(segments):
            s, w = cuts[(i + k) % segments]
            held |= ((1 << w) - 1) << s
            tests.append(f"bit_count({differ} & {_long(held)}) <= {(k + 1) * radius // segments}")
        chains.append("(" + " AND ".join(tests) + ")")
    return "(" + " OR ".join(chains) + ")"


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component_id) for each row: rows whose fingerprints are linked, by steps of ``radius`` bits or fewer.

    component_id is the smallest id reachable, itself included. A null or empty text has fingerprint zero and is linked
    like any other; repeated rows stay; a row with a null id takes part in the links but is never the smallest id.
    """
    rows = store.stash(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = store.stash(rows.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    root = components(ring_pairs(classes.select(F.col("fp").alias("id"), "fp"), radius, radius + 1, key_chain=2 if radius == 2 else 1))
    named = classes.join(root, classes.fp == root.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = store.stash(named.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select("id", "fp", "component_id")


def fp_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
