"""Words one edit apart, found by a frontier of states in a trie that is a distributed table, and grouped under their usual form.

The trie of all words is an adjacency table (node, kids): a node is the hash of a prefix, its kids are edges (letter, child,
whether a word ends there). A state holds two nodes, the walker's position in its own word and in the candidate, after one
edit; words with a common prefix share its states, so nothing is copied for each word. A replaced letter makes a state of any two
kids of one node; a deleted letter one of a kid and its node. Level by level, states are joined with the edge table at
both ends, and advance where the letters agree; states at which two words end are neighbours. Of several deletions with one
result only the last letter of a run is deleted, so each pair is reached once. Without an edit, both ends are the same node, so
those states are the trie itself.

Fan-out is bounded by the alphabet, so no node is hot, and levels by ``LONGEST``. Longer words are joined by the hashes of the
word less each letter in turn, which are as many as its letters. All pairs are verified by their edit distance, so equal hashes
add nothing; they lose nothing either, for a shared node has the kids of both prefixes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import store, text

LONGEST = 32  #: code points of a word that the trie takes
LEAST_LETTERS = 5
LEAST_COUNT = 3

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LATIN = 0xC3  # the first byte of U+00C0 to U+00FF
_YES = np.array([False, True])


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of what each span's prefix, of CRC ``begun``, and the span make together."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    crc, at, size = ~begun[order], starts[order], size[order]
    n_long = int(np.searchsorted(-size, -256, side="left"))  # spans of over 256 bytes go one by one
    for k in range(int(size[n_long]) if n_long < len(size) else 0):
        n = int(np.searchsorted(-size, -k, side="left"))
        now = crc[n_long:n]
        crc[n_long:n] = _CRC[(now ^ data[at[n_long:n] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    crc = ~crc
    for i in range(n_long):
        crc[i] = zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(crc[i]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _counted(ids: list, texts: pa.Array, corrupt: int, least: int) -> pa.RecordBatch | None:
    data, offsets = text.raw(texts)
    lead = data == _LATIN
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    starts, ends, of = text.spans(inside.view(np.uint8), offsets, _YES)
    if not len(starts):
        return None
    data = text.LOWER[data]
    pairs = np.concatenate([[0], np.cumsum(lead)])
    letters = (ends - starts) - (pairs[ends] - pairs[starts])
    hit = np.zeros(len(starts), bool)
    if corrupt:
        begun = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        crc = _crcs(data, starts, ends, begun[of])
        hit = crc % np.uint32(corrupt) == 0
    changed = []
    for i in np.flatnonzero(hit):
        word = data[starts[i] : ends[i]].tobytes().decode()
        k = int(crc[i]) % len(word)
        if len(word) > least:
            changed.append(word[:k] + word[k + 1 :])
    keep = ~hit & (letters >= least)
    starts, size = starts[keep], (ends - starts)[keep] if not keep.all() else ends - starts
    where = np.concatenate([[0], np.cumsum(size)])
    body = data[np.arange(where[-1]) + np.repeat(starts - where[:-1], size)]
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(where.astype(np.int64)), pa.py_buffer(body.tobytes()))
    counts = pc.value_counts(pa.concat_arrays([words, pa.array(changed, pa.large_string())]))
    return pa.RecordBatch.from_arrays([counts.field("values").cast(pa.string()), counts.field("counts")], ["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", corrupt: int = 0, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of at least ``least_letters`` code points
    and ``least_count`` occurrences.

    With ``corrupt``, a run whose crc32 of "<id>:<run>" it divides loses the code point at crc32 modulo its length. Counts are
    combined in the task before they are shuffled.
    """

    def run(batches):
        for b in text.pieces(batches, "text", 1 << 20):
            found = _counted(b.column("id").to_pylist(), b.column("text"), corrupt, least_letters)
            if found is not None:
                yield found

    rows = text.bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def trie(words: DataFrame) -> DataFrame:
    """(node, own, kids): the adjacency table of the words' trie; ``own`` says that a word ends at the node."""
    hashed = words.select("word", F.expr("transform(sequence(0, length(word)), i -> xxhash64(substring(word, 1, i)))").alias("h"))
    step = F.expr("transform(sequence(1, size(h) - 1), i -> struct(h[i - 1] AS node, substring(word, i, 1) AS c, h[i] AS child, i = size(h) - 1 AS ends))")
    edges = hashed.select(F.explode(step).alias("e")).select("e.*").groupBy("node", "c", "child").agg(F.max("ends").alias("ends"))
    edges = store.stash(edges, "trie-edges")
    kids = edges.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "child", "ends"))).alias("kids"))  # an alphabet at most
    own = edges.groupBy(F.col("child").alias("node")).agg(F.max("ends").alias("own"))
    whole = store.stash(kids.join(own, "node", "left").select("node", F.coalesce("own", F.lit(False)).alias("own"), "kids"), "trie")
    store.drop_stash(edges)
    return whole


_REPLACED = "flatten(transform(kids, (x, i) -> transform(slice(kids, i + 2, size(kids)), y -> struct(x.child AS a, y.child AS b, cast(null AS string) AS skip, x.ends AND y.ends AS both))))"
_DELETED = "transform(kids, x -> struct(x.child AS a, node AS b, x.c AS skip, x.ends AND own AS both))"
_AGREE = """flatten(transform(ka, x -> transform(filter(kb, y -> y.c = x.c AND (skip IS NULL OR y.c <> skip)),
    y -> struct(x.child AS a, y.child AS b, cast(null AS string) AS skip, x.ends AND y.ends AS both))))"""


def _frontier_pairs(words: DataFrame) -> DataFrame:
    """(a, b) hashes of words one edit apart, by levels of the trie."""
    tree = trie(words)
    states = store.stash(tree.select(F.explode(F.expr(f"concat({_REPLACED}, {_DELETED})")).alias("s")).select("s.*"), "frontier")
    found = store.stash(states.where("both").select("a", "b"), "neighbours")
    left, right = tree.select(F.col("node").alias("a"), F.col("kids").alias("ka")), tree.select(F.col("node").alias("b"), F.col("kids").alias("kb"))
    parts = [found]
    while not states.isEmpty():
        ahead = states.join(left, "a").join(right, "b").select(F.explode(F.expr(_AGREE)).alias("s")).select("s.*")
        old, states = states, store.stash(ahead, "frontier")
        parts.append(store.stash(states.where("both").select("a", "b"), "neighbours"))
        store.drop_stash(old)
    store.drop_stash(tree)
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionAll(more)
    return whole


def _without_each(word: str) -> tuple[np.ndarray, int]:
    """A hash of the word less each code point in turn, and of the whole word."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    up, _ = text._grown(len(codes) + 1)
    terms = codes * up[: len(codes)]
    after = codes * up[np.maximum(np.arange(len(codes)) - 1, 0)]  # what follows the gap moves one place up
    before = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    tail = np.concatenate([np.cumsum(after[::-1], dtype=np.uint64)[::-1], [np.uint64(0)]])
    return text.signed(text.mix(before[:-1] + tail[1:])), int(text.signed(text.mix(before[-1:]))[0])


def _long_pairs(words: DataFrame) -> DataFrame:
    """(a, b) hashes of words that may be one edit apart, of ``LONGEST`` code points and more: what they are less one letter is shared."""

    def run(batches):
        for b in batches:
            for name, word in zip(b.column("a").to_pylist(), b.column("word").to_pylist(), strict=True):
                gone, whole = _without_each(word)
                for i in range(0, len(gone) + 1, 1 << 16):
                    h = np.append(gone, whole)[i : i + (1 << 16)]
                    place = np.arange(i, i + len(h), dtype=np.int64)
                    if i + len(h) == len(gone) + 1:
                        place[-1] = -1
                    yield pa.RecordBatch.from_pydict({"a": pa.array(np.full(len(h), name), pa.int64()), "place": place, "h": h})

    keys = text.bounded(words).select(F.xxhash64("word").alias("a"), "word").mapInArrow(run, "a bigint, place bigint, h bigint")
    keys = store.stash(keys, "deletions")
    gone, whole = keys.where("place >= 0"), keys.where("place < 0").select(F.col("a").alias("b"), "h")
    other = gone.select(F.col("a").alias("b"), "place", "h")
    replaced = gone.join(other, ["place", "h"]).where("a < b").select("a", "b")  # of one pattern: a letter each
    deleted = gone.select("a", "h").distinct().join(whole, "h").select("a", "b")
    return replaced.unionAll(deleted).distinct()


def neighbours(words: DataFrame) -> DataFrame:
    """(word, other, other_n) for each word of (word, n) and each other one insertion, deletion or replacement away."""
    short, long = words.where(F.length("word") <= LONGEST), words.where(F.length("word") >= LONGEST)
    pairs = _frontier_pairs(short).unionAll(_long_pairs(long)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x = words.select(F.xxhash64("word").alias("a"), F.col("word").alias("wa"), F.col("n").alias("na"))
    y = words.select(F.xxhash64("word").alias("b"), F.col("word").alias("wb"), F.col("n").alias("nb"))
    pairs = store.stash(pairs.join(x, "a").join(y, "b").where("levenshtein(wa, wb, 1) = 1"), "pairs")
    return pairs.select(F.col("wa").alias("word"), F.col("wb").alias("other"), F.col("nb").alias("other_n")).unionAll(pairs.select("wb", "wa", "na"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word with a form: pointers that double until none moves. Counts double from a form to the next, so
    there are few rounds, and words that have arrived take no part in the next."""
    moving = forms.where("form IS NOT NULL").select("word", F.col("form").alias("at"))
    steps, done = moving, []
    while True:
        ahead = steps.select(F.col("word").alias("at"), F.col("at").alias("next"))
        now = store.stash(moving.join(ahead, "at", "left").select("word", "at", "next"), "roots")
        done.append(now.where("next IS NULL").select("word", F.col("at").alias("root")))
        moving = now.where("next IS NOT NULL").select("word", F.col("next").alias("at"))
        if moving.isEmpty():
            break
        steps = now.select("word", F.coalesce("next", "at").alias("at")) if len(done) == 1 else _merged(now, steps)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionAll(more)
    return whole


def _merged(now: DataFrame, steps: DataFrame) -> DataFrame:
    """All pointers: those that moved in ``now``, and the others as they were."""
    moved = now.select("word", F.coalesce("next", "at").alias("to"))
    return store.stash(steps.join(moved, "word", "left").select("word", F.coalesce("to", "at").alias("at")), "pointers")


def group(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of (word, n).

    A word's form is its neighbour of largest n, ties to the smallest in code-point order, if that n is at least ``ratio`` times
    the word's own; root is where forms lead from the word, itself if nowhere. An empty table gives an empty result.
    """
    words = store.stash(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    usual = F.expr(f"coalesce(-best.less >= {ratio} * n, false)")
    form, form_n = F.when(usual, F.col("best.other")), F.when(usual, -F.col("best.less"))
    forms = words.join(near, "word", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), form_n.alias("form_n"))
    forms = store.stash(forms, "forms")
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", corrupt: int = 0) -> DataFrame:
    """``group`` of the ``vocabulary`` of ``docs``.

    A null text has no words; a null id is written as nothing before the colon; repeated rows are counted each; a text of any
    length is taken whole; an empty table gives an empty result; other columns are not read.
    """
    return group(vocabulary(docs, id_col, text_col, corrupt))
