"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

Words are runs of letters, digits and non-ASCII bytes, ASCII lower-cased. An item of n words is compared with windows of n
words; both are multisets of 5-word shingles (fewer words: the whole sequence), and similarity is the sum of the smaller
counts over the sum of the larger.

Windows are fingerprinted by SimHash, and the items that a window may be like are found through the Hamming index of the items
of its size: fingerprints are cut into four blocks of 16 bits, of which one differs in at most a quarter of the radius, and a
table for each block lists by the block's value all items that near. So every item within the radius is listed, then checked
by the whole distance, and what is left is verified by the exact similarity. Fingerprints of few shingles are noisy, and a
shingle that is there eight times moves a bit eight times as far, so each item has radii of its own, by its size and the
counts of its shingles: they hold all but one in 2,000 of the pairs at a similarity of 0.8, found by a seeded simulation that
takes away the item's most or its least repeated shingles. The smaller radius is for windows without a repeated shingle. For
others, where what is new may be one shingle again and again, the larger radius is one that blocks hardly prune by, so the
whole distance to every item of the size is computed.

Only windows that hold at least one shingle of some item are fingerprinted; others have a similarity of zero to every item.
A document of fewer words than the item is one window, compared without a fingerprint. An item of fewer than five words is
one shingle, so it is like a window only if they are equal; such items are looked up by the hash of the sequence.

Items are a stated query set; they are taken in blocks of ``ITEMS``, so what the driver and each task hold is bounded. A task
receives a block's texts and builds the index once in a worker.
"""

from __future__ import annotations

import uuid
from collections import Counter, OrderedDict, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import text

SHINGLE = 5
LEAST = 0.8
LOST = 1 / 2000  #: of the pairs at LEAST, what the radius may lose
BLOCKS = 4
ITEMS = 2048
_SEED_BITS = 22

_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_MULTIPLIER = np.uint64(0x9FB21C651E98DF25)


def _shingles(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and row of each shingle, in order; a row of fewer words has one."""
    if not len(h):
        return h, row, row
    out = np.zeros(len(h), np.uint64)
    for k in range(SHINGLE):
        out[: len(h) - k] = out[: len(h) - k] * _MULTIPLIER + h[k:]
    ends = np.searchsorted(row, row, side="right")
    at = np.arange(len(h))
    whole = at + SHINGLE <= ends
    short = np.flatnonzero((np.searchsorted(row, row, side="left") == at) & ~whole)
    for s in short.tolist():
        total = np.uint64(0)
        for x in h[s : ends[s]]:
            with np.errstate(over="ignore"):
                total = total * _MULTIPLIER + x
        out[s] = total
    whole[short] = True
    at = np.flatnonzero(whole)
    return text.mix(out[at]), at, row[at]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    data, offsets = text.raw(column)
    data = text.LOWER[data]
    starts, ends, row = text.spans(data, offsets, _IN_WORD)
    return text.hashes(data, starts, ends), row


def simhash(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


@cache
def radius(shingles: int | tuple[int, ...], least: float = LEAST, again: bool = False) -> int:
    """The distance that all but LOST of the pairs at a similarity of ``least`` keep to: an item with so many shingles, or with
    these counts of each, and a window of the same size, whose new shingles are all different or, with ``again``, one."""
    counts = sorted((1,) * shingles if isinstance(shingles, int) else shingles, reverse=True)
    size = sum(counts)
    new = size - int(np.ceil(least * 2 * size / (1 + least) - 1e-9))
    rng = np.random.default_rng(size)
    draw = lambda n: 2 * rng.binomial(n, 0.5, (4096, 64)) - n  # noqa: E731  # a sum of n signs, for each bit
    found = 0
    for order in {tuple(counts), tuple(counts[::-1])}:
        left, kept, gone, once = new, np.zeros((4096, 64), np.int64), np.zeros((4096, 64), np.int64), [0, 0]
        for c in order:
            less = min(c, left)
            left -= less
            if c == 1:
                once[less] += 1
                continue
            sign = draw(1)
            kept += (c - less) * sign
            gone += less * sign
        kept += draw(once[0])
        gone += draw(once[1])
        added = new * draw(1) if again else draw(new)
        distance = ((kept + gone > 0) != (kept + added > 0)).sum(axis=1)
        found = max(found, int(np.quantile(distance, 1 - LOST, method="higher")))
    return found


class Index:
    """The items of one block: shingle multisets, and by size in words their fingerprints and Hamming blocks."""

    def __init__(self, ids: list, texts: list[str | None], least: float = LEAST) -> None:
        h, row = words_of(pa.array([t or "" for t in texts], pa.large_string()))
        sh, _, at = _shingles(h, row)
        self.ids, self.n_words, self.least = ids, np.bincount(row, minlength=len(ids)), least
        self.bags = [Counter(sh[at == i].tolist()) for i in range(len(ids))]
        self.items_of: dict[int, list[int]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # by size and hash
        for i, bag in enumerate(self.bags):
            for s in bag:
                if self.n_words[i] >= SHINGLE:
                    self.items_of[s].append(i)
                else:
                    self.short[int(self.n_words[i])][s].append(i)
        self.seeds = np.zeros(1 << _SEED_BITS, bool)
        keys = np.array(sorted(self.items_of), np.uint64)
        self.seeds[(keys & np.uint64((1 << _SEED_BITS) - 1)).astype(np.int64)] = True
        self.keys = keys
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]] = {}
        self.wide: dict[int, np.ndarray] = {}  # by size: each item's radius for windows with repeated shingles
        values = np.arange(1 << 16, dtype=np.uint16)
        for n in np.unique(self.n_words[self.n_words >= SHINGLE]).tolist():
            own = np.flatnonzero(self.n_words == n)
            known = np.array([np.packbits(simhash(sh[at == i]).sum(axis=0) > 0) for i in own], np.uint8).view(np.uint16)
            counts = [tuple(sorted(self.bags[i].values())) for i in own.tolist()]
            far, tables = np.array([radius(c, least) for c in counts]), []
            self.wide[n] = np.array([radius(c, least, True) for c in counts])
            for k in range(BLOCKS):
                near = np.bitwise_count(values[:, None] ^ known[None, :, k]) <= far // BLOCKS
                tables.append(np.packbits(near, axis=1, bitorder="little"))  # a bit for each item
            self.by_size[n] = own, known, tables, far

    @classmethod
    def of(cls, name: str, ids: list, texts: list[str | None], least: float) -> Index:
        """The index of a block, kept in the worker for its next tasks; the last few blocks are kept."""
        if name not in _indexes:
            _indexes[name] = cls(ids, texts, least)
            while len(_indexes) > 2:
                _indexes.popitem(last=False)
        return _indexes[name]

    def listed(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place among the items of ``n`` words) of what the tables list for fingerprints of four 16-bit blocks."""
        tables = self.by_size[n][2]
        near = tables[0][prints[:, 0]].copy()
        for k in range(1, BLOCKS):
            near |= tables[k][prints[:, k]]
        some = np.flatnonzero(near.any(axis=1))
        w, i = np.nonzero(np.unpackbits(near[some], axis=1, bitorder="little"))
        return some[w], i

    def lookup(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items of ``n`` words within the radius of each fingerprint."""
        own, known, _, far = self.by_size[n]
        w, i = self.listed(n, prints)
        ok = np.bitwise_count(prints[w] ^ known[i]).sum(axis=1) <= far[i]
        return w[ok], own[i[ok]]

    def near(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``lookup`` for windows with repeated shingles: all fingerprints of the size, by the larger radii."""
        own, known, _, _ = self.by_size[n]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a in range(0, len(prints), 256):
            apart = sum(np.bitwise_count(prints[a : a + 256, None, k] ^ known[None, :, k]).astype(np.int64) for k in range(BLOCKS))
            w, i = np.nonzero(apart <= self.wide[n])
            found.append((w + a, own[i]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def sequences(self, h: np.ndarray, row: np.ndarray) -> list[tuple[int, int, float, int]]:
        """(row, item, 1.0, first word) of the items of fewer than five words that a row holds."""
        best: dict[tuple[int, int], int] = {}
        for n, items in self.short.items():
            if not n or len(h) < n:
                continue
            total = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                total = total * _MULTIPLIER + h[k : len(h) - n + 1 + k]
            total = text.mix(total)
            keys = np.array(sorted(items), np.uint64)
            hit = np.flatnonzero(np.isin(total, keys) & (row[: len(total)] == row[n - 1 :]))
            for p in hit.tolist():
                for i in items[int(total[p])]:
                    best.setdefault((int(row[p]), i), p - int(np.searchsorted(row, row[p])))
        return [(r, i, 1.0, w) for (r, i), w in best.items()]

    def scan(self, column: pa.Array) -> list[tuple[int, int, float, int]]:
        """(row, item, similarity, first word) of the most similar window of each row and item that are alike."""
        h, row = words_of(column)
        sh, _, own = _shingles(h, row)
        hit = np.flatnonzero(self.seeds[(sh & np.uint64((1 << _SEED_BITS) - 1)).astype(np.int64)])
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, sh[hit]), len(self.keys) - 1)
            hit = hit[self.keys[at] == sh[hit]]
        else:
            hit = hit[:0]
        seeds: dict[tuple[int, int], set[int]] = defaultdict(set)  # by row and size
        for p, s, r in zip(hit.tolist(), sh[hit].tolist(), own[hit].tolist(), strict=True):
            for n in {int(self.n_words[i]) for i in self.items_of[s]}:
                seeds[r, n].add(p)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for (r, n), where in seeds.items():
            first, last = np.searchsorted(own, [r, r + 1])
            k = n - SHINGLE + 1
            if last - first < k:  # fewer words than the item: the whole document is the window
                window = Counter(sh[first:last].tolist())
                for i in {i for p in where for i in self.items_of[int(sh[p])] if self.n_words[i] == n}:
                    same = (window & self.bags[i]).total()
                    similar = same / (int(last - first) + k - same)
                    if similar >= self.least:
                        best[r, i] = similar, 0
                continue
            mine = sh[first:last]
            order = np.argsort(mine, kind="stable")
            again = np.full(len(mine) + 1, 1 << 62)  # where a shingle at or after a place comes next
            same_ = np.flatnonzero(mine[order][1:] == mine[order][:-1])
            again[order[same_]] = order[same_ + 1]
            again = np.minimum.accumulate(again[::-1])[::-1] + first
            begins = np.unique(np.concatenate([np.arange(max(first, p - k + 1), min(p, last - k) + 1) for p in where]))
            for c in range(0, len(begins), 4096):
                part = begins[c : c + 4096]
                lo, hi = int(part[0]), int(part[-1]) + k
                total = np.zeros((hi - lo + 1, 64), np.int32)
                np.cumsum(simhash(sh[lo:hi]), axis=0, out=total[1:])
                prints = np.packbits(total[part - lo + k] - total[part - lo] > 0, axis=1).view(np.uint16)
                repeats = again[part - first] < part + k
                some = [(np.flatnonzero(m), f) for m, f in ((~repeats, self.lookup), (repeats, self.near)) if m.any()]
                pairs = [(at[w], i) for at, f in some for w, i in [f(n, prints[at])]]
                listed = sorted((int(w), int(i)) for w_, i_ in pairs for w, i in zip(w_, i_, strict=True))
                for w, i in listed:
                    b = int(part[w])
                    bag, window = self.bags[i], Counter(sh[b : b + k].tolist())
                    same = sum(min(c, bag[s]) for s, c in window.items() if s in bag)
                    similar = same / (2 * k - same)
                    if similar >= self.least and similar > best.get((r, i), (-1.0, 0))[0]:
                        best[r, i] = similar, b - int(first)
        found = [(r, i, s, b) for (r, i), (s, b) in best.items()]
        return sorted(found + (self.sequences(h, row) if self.short else []))


_indexes: OrderedDict[str, Index] = OrderedDict()


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[str, Broadcast]]:
    """A name and the (ids, texts) of each block of items, broadcast; the driver holds one block at a time."""
    spark = items.sparkSession
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").distinct()
    n = -(-rows.count() // ITEMS)
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).orderBy("i", "t").collect()
        yield uuid.uuid4().hex, spark.sparkContext.broadcast(([r[0] for r in got], [r[1] for r in got]))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.8) -> DataFrame:
    """(id, item_id, similarity, first_word) for each row of ``docs`` and item with a window of that similarity or more.

    Of several windows the most similar is named, then the first; a document of fewer words than the item is one window. An
    item of fewer than five words matches where a text holds just its words in a row. Null and empty texts, of documents or
    items, match nothing; ids may repeat or be null (each row of ``docs`` is matched on its own, a repeated item once); empty
    tables give an empty result.
    """
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    rows = text.bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for name, held in _blocks(items, item_id, item_text):

        def run(batches, name=name, held=held):
            index = Index.of(name, *held.value, least)
            for b in text.pieces(batches, "text"):
                found = index.scan(b.column("text"))
                if found:
                    r, i, s, w = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(r)), pa.array([index.ids[k] for k in i]), pa.array(s), pa.array(w, pa.int64())], ["id", "item_id", "similarity", "first_word"])

        found = rows.mapInArrow(run, f"id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word bigint")
        out = found if out is None else out.unionAll(found)
    return out if out is not None else rows.select("id", F.lit(None).cast(kinds[1]).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("bigint").alias("first_word")).where("false")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, that match no item; one pass for each block of items, no shuffle."""
    for name, held in _blocks(items, item_id, item_text):

        def run(batches, name=name, held=held):
            index = Index.of(name, *held.value, least)
            for whole in batches:
                keep, done = np.ones(whole.num_rows, bool), 0
                for b in text.pieces(iter([whole]), text_col):
                    for r, _, _, _ in index.scan(b.column(b.schema.get_field_index(text_col))):
                        keep[done + r] = False
                    done += b.num_rows
                yield whole.filter(pa.array(keep))

        docs = text.bounded(docs).mapInArrow(run, docs.schema)
    return docs
