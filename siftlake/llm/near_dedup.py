"""One document of each near-duplicate group: five-word shingles, similarity 0.8 or more.

Every text has a SimHash fingerprint of its distinct shingles. At a similarity of 0.8 two 64-bit fingerprints differ in 10
bits on average, give or take 3, so a radius that loses no pair (``RADIUS``) leaves pigeonring keys of two bits, which select
nothing. Candidates therefore come from ``BANDS`` keys of ``ROWS`` minimum hashes each: a pair alike at 0.8 shares none with
a chance of (1 - 0.8 ** ROWS) ** BANDS, 3 in 100,000. Keys are 64 bits wide, so what shares one grows with the corpus and
not with its square. The pigeonring test on the fingerprints (a chain of segments whose every prefix stays within its share of
the radius), the sizes, and a sketch of two bits of each minimum prune candidates before the exact comparison of shingle sets.

A group of n near copies has n**2 candidate pairs; they are never rows. Each key has a leader, the text that comes first in one
order over all keys, and first each text meets the ``LEADERS`` first of its keys' leaders. Verified links join them to
components. In keys whose texts lie in several components, each text then meets a few drawn from the others, which joins what
is left of a large group. At last, in the keys that still are in several components, the texts outside the largest meet all
texts of other components. Every candidate pair is therefore either verified or inside a component already; the first two
searches only save work. A hot key or leader is dealt out over tasks in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.llm import store, text
from siftlake.llm.bits import filter_bits, passes
from siftlake.llm.components import components
from siftlake.llm.decontaminate import _shingles
from siftlake.llm.simhash import SEED, ring_test

SHINGLE = 5
RADIUS, SEGMENTS = 21, 7  #: four deviations beyond the mean distance at 0.8
BANDS, ROWS = 20, 4
DIFFERENT = 21  #: of 64 minima, those whose two low bits may differ: four deviations too
BLOCK = 512
LEADERS = 3  #: that a text meets at first
DRAWN, MEETINGS = 2, 12  #: texts drawn from each key to be met next, and how many of them a text meets

_DRAWS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text in ascending order, text by text, and where each text's begin and end.

    Fewer words are one shingle, no word none. Words are runs of bytes other than ASCII white space, A-Z lower-cased.
    """
    data, offsets = text.raw(column)
    data = text.LOWER[data]
    starts, ends, row = text.spans(data, offsets)
    h, _, own = _shingles(text.hashes(data, starts, ends), row)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[first], own[first]
    return h, np.searchsorted(own, np.arange(len(offsets)))


def signatures(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each shingle set: SimHash, BANDS keys, and (two) sketch words of its minimum hashes; zeros for an empty set."""
    n = len(bounds) - 1
    fp, keys, sketch = np.zeros(n, np.uint64), np.zeros((n, BANDS), np.uint64), np.zeros((n, 2), np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if not len(some):
        return fp, keys, sketch
    begins, sizes = bounds[some], np.diff(bounds)[some]
    ones = np.zeros((len(some), 64), np.int64)
    for a in range(0, len(some), 256):  # bits of a few sets at a time
        z = min(a + 256, len(some))
        lo, hi = begins[a], begins[z - 1] + sizes[z - 1]
        for k in range(64):
            ones[a:z, k] = np.add.reduceat((h[lo:hi] >> np.uint64(63 - k)) & np.uint64(1), begins[a:z] - lo)
    fp[some] = np.packbits(ones * 2 > sizes[:, None], axis=1).view(">u8").ravel()
    least = np.stack([np.minimum.reduceat(h * (a | np.uint64(1)) + b, begins) for a, b in _DRAWS.T], axis=1)
    least = text.mix(least)
    band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(some), BANDS))
    for k in range(ROWS):
        band = text.mix(band * np.uint64(0x9E3779B97F4A7C15) + least[:, k::ROWS])
    keys[some] = band
    for k in (0, 1):
        bits = ((least[:, :64] >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)
        sketch[some, k] = np.packbits(bits, axis=1).view(np.uint64).ravel()
    return fp, keys, sketch


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``least`` or more; two empty ones have."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    if not len(a):
        return True
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return common >= least * (len(a) + len(b) - common) - 1e-9


def _digests(column: pa.Array) -> list[bytes]:
    """128 bits of each text's lower-cased words."""
    return [xxhash.xxh3_128_digest(b" ".join(t.as_buffer().to_pybytes().lower().split())) for t in column]


def _half(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64)[::2]


def _profiles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, k, id, fp, n, bands, m1, m2) of each row; k is the digest's first half, n the size of the shingle set."""

    def run(batches):
        for b in text.pieces(batches, "text"):
            digest = _digests(b.column("text"))
            h, bounds = shingle_sets(b.column("text"))
            fp, keys, sketch = signatures(h, bounds)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(text.signed(keys).ravel()))
            columns = [pa.array(digest, pa.binary()), pa.array(_half(digest).view(np.int64)), b.column("id"), pa.array(text.signed(fp))]
            columns += [pa.array(np.diff(bounds)), lists, *(pa.array(text.signed(sketch[:, k])) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "k", "id", "fp", "n", "bands", "m1", "m2"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = text.bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"digest binary, k bigint, id {kind}, fp bigint, n bigint, bands array<bigint>, m1 bigint, m2 bigint")


def _likely(least: float) -> str:
    """The tests that pairs x, y must pass before their sets are compared."""
    sizes = f"x.n >= {least} * y.n AND y.n >= {least} * x.n"
    sketch = f"bit_count((x.m1 ^ y.m1) | (x.m2 ^ y.m2)) <= {DIFFERENT}"
    return f"{sizes} AND {sketch} AND {ring_test('(x.fp ^ y.fp)', RADIUS, SEGMENTS)}"


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets (id, s) are alike. A text in many pairs is ``a``; its pairs are dealt in blocks, and each
    task streams them past the one set it holds."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    b = pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    b = b.join(sets.withColumnRenamed("id", "b"), "b").select("a", "block", F.lit(1).alias("order"), "b", "s")
    a = blocks.select("a", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    a = a.join(sets.withColumnRenamed("id", "a"), "a").select("a", "block", F.lit(0).alias("order"), F.col("a").alias("b"), "s")

    def run(batches):
        held, own = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            order, s = batch.column("order").to_pylist(), batch.column("s")
            found = []
            for i in range(batch.num_rows):
                values = np.frombuffer(s[i].as_buffer(), np.uint64)
                if order[i] == 0:
                    held, own = a[i], values.copy()
                elif held == a[i] and alike(own, values, least):
                    found.append(i)
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in found], pa.int64()), "b": pa.array([b[i] for i in found], pa.int64())})
        text.tidy()

    dealt = a.unionAll(b).repartition("a", "block").sortWithinPartitions("a", "block", "order")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _across(rows: DataFrame, classes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join the components of each key's texts: rows are (key, id, c, major, few).

    A task streams a key's texts past a block of those outside its largest component. Pairs are no rows: they are tested,
    those of one component are passed over, a pair is compared in the first key that it shares, and a link is returned only
    if it joins two components in its block.
    """
    wide = rows.join(classes.select("id", "fp", "n", "m1", "m2", "bands"), "id").join(sets, "id")
    wide = wide.withColumn("minor", F.col("c") != F.col("major")).drop("major")
    held = wide.where("minor").withColumn("block", F.pmod(F.xxhash64("id"), F.col("few")).cast("int")).withColumn("side", F.lit(0))
    every = wide.withColumn("block", F.explode(F.expr("sequence(0, few - 1)"))).withColumn("side", F.lit(1))
    dealt = held.unionByName(every).drop("few").repartition("key", "block").sortWithinPartitions("key", "block", "side")

    def fields(b: pa.RecordBatch, at: slice) -> dict:
        own = b.slice(at.start, at.stop - at.start)
        out = {c: own.column(c).to_numpy(zero_copy_only=False) for c in ("id", "c", "n", "minor")}
        out |= {c: own.column(c).to_numpy().view(np.uint64) for c in ("fp", "m1", "m2")}
        out["bands"] = own.column("bands").flatten().to_numpy().reshape(-1, BANDS)
        return out | {"s": [np.frombuffer(x.as_buffer(), np.uint64) for x in own.column("s")]}

    def run(batches):
        now, x, root = None, [], {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        for b in batches:
            key, block, side = (b.column(c).to_numpy() for c in ("key", "block", "side"))
            new = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
            found = []
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), b.num_rows], strict=True):
                if (key[lo], block[lo]) != now:
                    now, x, root = (key[lo], block[lo]), [], {}
                if not side[lo]:
                    x.append(fields(b, slice(lo, hi)))
                    x[-1]["s"] = [v.copy() for v in x[-1]["s"]]
                    continue
                if len(x) > 1:
                    x = [{c: np.concatenate([p[c] for p in x]) if c != "s" else [v for p in x for v in p[c]] for c in x[0]}]
                u = x[0]
                p = int(np.flatnonzero(u["bands"][0] == key[lo])[0])
                for at in range(lo, hi, 256):
                    y = fields(b, slice(at, min(at + 256, hi)))
                    ok = (u["c"][:, None] != y["c"]) & (~y["minor"] | (u["id"][:, None] < y["id"]))
                    ok &= (u["n"][:, None] >= least * y["n"]) & (y["n"] >= least * u["n"][:, None])
                    ok &= np.bitwise_count((u["m1"][:, None] ^ y["m1"]) | (u["m2"][:, None] ^ y["m2"])) <= DIFFERENT
                    ok &= np.bitwise_count(u["fp"][:, None] ^ y["fp"]) <= RADIUS
                    for q in range(p):
                        ok &= u["bands"][:, None, q] != y["bands"][:, q]
                    for i, j in zip(*(z.tolist() for z in np.nonzero(ok)), strict=True):
                        one, two = find(int(u["c"][i])), find(int(y["c"][j]))
                        if one != two and alike(u["s"][i], y["s"][j], least):
                            root[one] = two
                            found.append((int(u["id"][i]), int(y["id"][j])))
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})
        text.tidy()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """(digest, k, first, c, root): each distinct text (by its lower-cased words), its smallest id, how many rows have it, and
    its group."""
    classes = _profiles(docs, id_col, text_col).groupBy("digest").agg(
        F.count("*").alias("c"),
        F.min("id").alias("first"),
        *[F.any_value(x).alias(x) for x in ("k", "fp", "n", "bands", "m1", "m2")],
    )
    classes = store.stash(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    features = classes.select("id", "fp", "n", "m1", "m2")

    # keys that two texts share, with their leader by one order over all keys
    banded = classes.where("n > 0").select("id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("o"), F.col("id"))).alias("y"), F.count("*").alias("m")).where("m > 1")
    banded = store.stash(banded.join(shared.select("key", F.col("y.o").alias("o"), F.col("y.id").alias("leader")), "key"), "banded")

    def with_features(pairs: DataFrame) -> DataFrame:
        """Likely pairs of ids a, b."""
        x, y = features.alias("x"), features.alias("y")
        found = pairs.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id"))
        return found.where(F.expr(_likely(least))).select("a", "b")

    met = banded.where("id <> leader").select("id", "o", "leader").distinct()
    met = met.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("o", "leader"))).where(F.col("place") <= LEADERS)  # of BANDS at most
    stars = with_features(met.select(F.col("leader").alias("a"), F.col("id").alias("b")))
    stars = store.stash(stars, "stars")

    # shingle sets of the texts that share a key; only what a filter of their digests lets through is shuffled
    wanted = store.stash(classes.select("id", "digest", "k").join(banded.select("id").distinct(), "id"), "wanted")
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(wanted, "k"))

    def sets_of(batches):
        seen: set[bytes] = set()
        for b in text.pieces(batches, "text"):
            digest = _digests(b.column("text"))
            ok = passes(bits.value, _half(digest))
            at = [i for i in np.flatnonzero(ok).tolist() if digest[i] not in seen]
            at = list({digest[i]: i for i in at}.values())
            if not at:
                continue
            seen.update(digest[i] for i in at)
            h, bounds = shingle_sets(b.column("text").take(pa.array(at)))
            s = [h[p:q].tobytes() for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([digest[i] for i in at], pa.binary()), pa.array(s, pa.binary())], ["digest", "s"])

    texts = text.bounded(docs).select(F.col(text_col).alias("text")).mapInArrow(sets_of, "digest binary, s binary")
    sets = texts.join(wanted.select("digest", "id"), "digest").groupBy("id").agg(F.any_value("s").alias("s"))
    sets = store.stash(sets, "sets")

    links = store.stash(_verified(stars, sets, least), "links")

    def parted(links: DataFrame) -> DataFrame:
        """(key, id, c, major, few): the texts of the keys that lie in several components so far, the largest of these, and the
        blocks of ``BLOCK`` that the texts outside it fill."""
        part = components(links)
        named = banded.select("key", "id").join(part, banded.id == part.node, "left").select("key", "id", F.coalesce("root", "id").alias("c"))
        named = store.stash(named, "named")
        of_key = named.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key")
        of_key = of_key.agg(F.max_by("c", F.struct("m", "c")).alias("major"), F.sum("m").alias("all"), F.max("m").alias("most")).where("most < all")
        return named.join(of_key.select("key", "major", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("few")), "key")

    # texts meet a few drawn texts of other components in their keys: members of one group that is not joined yet
    rows = store.stash(parted(links), "parted")
    drawn = rows.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(DRAWN)).alias("draw")).agg(F.min(F.struct(F.xxhash64("id", F.lit(1)).alias("o"), F.col("id"), F.col("c"))).alias("y"))
    drawn = rows.alias("x").join(drawn.alias("d"), "key").where("x.c <> y.c").select("id", "y.o", F.col("y.id").alias("guest")).distinct()
    drawn = drawn.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("o", "guest"))).where(F.col("place") <= MEETINGS)  # of BANDS * DRAWN at most
    drawn = store.stash(with_features(drawn.select(F.col("guest").alias("a"), F.col("id").alias("b"))), "drawn")
    links = links.unionAll(store.stash(_verified(drawn, sets, least), "links"))

    # what is left: in every key whose texts lie in several components, those outside the largest meet the others
    last = store.stash(_across(parted(links), classes, sets, least), "links")
    final = components(links.unionAll(last))
    for t in (banded, stars, wanted, sets, rows, drawn):
        store.drop_stash(t)
    return store.stash(classes.join(final, classes.id == final.node, "left").select("digest", "k", "first", "c", F.coalesce("root", "id").alias("root")), "groups")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """One row of each group of near duplicates, all columns: the one with the smallest id.

    Texts are compared by lower-cased words, so copies that differ in case or white space are equal, and all texts without
    words (null and empty ones) are one group. A row with a null id stays only if its group has no other; of repeated rows
    one stays, and of different rows with one id and equal words any one.
    """
    found = groups(docs, id_col, text_col, least)
    # the class that holds the group's smallest id; a null sorts last
    order = F.struct(F.col("first").isNull().alias("n"), F.col("first").alias("first"), F.col("digest").alias("digest"))
    several = store.stash(found.groupBy("root").agg(F.min(order).alias("best"), F.sum("c").alias("rows")).where("rows > 1"), "several")
    keep = several.select("best.digest", "best.first")
    # rows of no such group stay without being shuffled; the few that pass by chance are told apart by the joins
    members = found.join(several.select("root"), "root", "left_semi")
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(members, "k"))
    names = docs.columns

    def keyed(batches):
        at = names.index(text_col)
        for whole in batches:
            done = 0
            for b in text.pieces(iter([whole]), text_col):
                digest = _digests(b.column(at))
                part = whole.slice(done, b.num_rows)
                done += b.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digest, pa.binary()), pa.array(passes(bits.value, _half(digest)))], [*names, "__digest", "__open"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    rows = docs.mapInArrow(keyed, f"{fields}, __digest binary, __open boolean")
    alone = rows.where("NOT __open").select(*names)
    open_ = rows.where("__open")
    same = open_["__digest"] == members["digest"]
    chance = open_.join(members, same, "left_anti").select(*names)
    best = (open_["__digest"] == keep["digest"]) & F.col(id_col).eqNullSafe(keep["first"])
    kept = open_.join(keep, best, "left_semi").dropDuplicates(["__digest"]).select(*names)
    return alone.unionAll(chance).unionAll(kept)
