"""A binary token store: ids of many documents one after the other, and Elias-Fano coded boundaries and document ids.

A shard file holds, in this order: all ids (2 or 4 bytes each, little-endian); the Elias-Fano coded ends of the documents
in ids; the Elias-Fano coded document ids less the first one; a JSON footer; its length (4 bytes); the magic number.
A value costs about 2 + log2(range / count) bits. Every ``SAMPLE``-th one's place is stored with the bits, so ``select`` finds
one offset, and ``decode`` a range of them, without reading the rest and without a table of 64-bit offsets.

Writing: texts are encoded where they lie, and only ids are shuffled. Shards are ranges of (document id, hash of the text) with
about ``SHARD_BYTES`` of text each, by the running sum of bytes in that order, so long documents, a null id or an id that many
rows share are spread as well. There are at most ``SHARDS`` of them, whose bounds are broadcast; beyond that they grow. A shard
is written as a stream by one task. A task that runs again writes another file; only files named in the manifest count. Reading: each task
takes a range of a shard's documents, finds it by ``select`` and reads that part of the file alone.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.llm import store, text
from siftlake.llm.tokens import Encoder

MAGIC = b"EFTOKEN1"
SAMPLE = 256  #: every so many ones, the select structure keeps a position
SHARD_BYTES = 32 << 20  #: of text
SHARDS = 1 << 16
CUTS = 8  #: places of a shard's width at which it may end
RANGE = 2048  #: documents that a reading task takes


class EliasFano:
    """A non-decreasing sequence of unsigned integers in near-minimal space: low bits packed, high bits in unary, and the
    position of every ``SAMPLE``-th one among the high bits."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, np.frombuffer(high, np.uint8), samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = np.zeros(n + (top >> low_bits) + 1, np.uint8)
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        ones[at] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, low_bits, low, np.packbits(ones, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", data)
        at = struct.calcsize("<QBQQ")
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), at + a + b)
        return cls(n, low_bits, data[at : at + a], data[at + a : at + a + b], samples)

    def _lows(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8)[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 :][: b - a]
        return (bits.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Values ``first`` to ``last`` (all by default): the high bits between the samples around them are read."""
        last = self.n if last is None else last
        if first >= last:
            return np.zeros(0, np.uint64)
        s = first // SAMPLE
        start = int(self.samples[s]) // 8
        after = -(-last // SAMPLE)
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start:end], bitorder="little")) + 8 * start
        ones = ones[ones >= int(self.samples[s])][first - s * SAMPLE :][: last - first]
        return ((ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(first, last)

    def select(self, i: int) -> int:
        """Value ``i`` alone: from the sample before it on, bytes are counted until its one is reached."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        byte, left = place // 8, i % SAMPLE
        bits = int(self.high[byte]) >> place % 8 << place % 8
        while (count := bits.bit_count()) <= left:
            left, byte = left - count, byte + 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        at = 8 * byte + (bits & -bits).bit_length() - 1
        return ((at - i) << self.low_bits) | int(self._lows(i, i + 1)[0])


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI; one without a scheme is of the cluster's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


_NONE = np.iinfo(np.int64).min  # where a null id stands in the order


def _order() -> list[Column]:
    return [F.col("id").asc_nulls_first(), F.col("h")]


def _bounds(rows: DataFrame, shards: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The last (id, h) of every shard but the last, at even places of the running sum of bytes; one that is larger than a
    shard's width comes several times. The driver gets CUTS * SHARDS rows at most, whatever the corpus."""
    keys = store.stash(rows.groupBy("id", "h").agg(F.sum(F.octet_length("text") + 1).alias("bytes")), "sizes")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    n = min(shards or -(-total // SHARD_BYTES), SHARDS)
    none = np.zeros(0, np.int64)
    if n < 2:
        store.drop_stash(keys)
        return none, none
    step = max(1, total // (CUTS * n))

    def cuts(batches):
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            upto = at + np.cumsum(b.column("bytes").to_numpy())
            before = np.concatenate([[at], upto[:-1]]) // step
            times = upto // step - before  # the steps that end inside a key's bytes
            hit = np.repeat(np.arange(len(upto)), times)
            place = (before[hit] + 1 + np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times)) * step
            at = int(upto[-1]) if len(upto) else at
            if len(hit):
                known = pc.fill_null(b.column("id"), int(_NONE)).to_numpy()
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(hit), part), pa.int32()), "id": known[hit], "h": b.column("h").to_numpy()[hit], "upto": place, "last": np.zeros(len(hit), bool)})
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "id": [0], "h": [0], "upto": [at], "last": [True]})

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with store.cleaned(rows.sparkSession):
        dealt = keys.repartitionByRange(parts, *_order()).sortWithinPartitions(*_order())
        found = dealt.mapInArrow(cuts, "part int, id bigint, h bigint, upto bigint, last boolean").toArrow()
    store.drop_stash(keys)
    part, ids, h, upto, last = (found.column(c).to_numpy() for c in ("part", "id", "h", "upto", "last"))
    sizes = np.zeros(parts + 1, np.int64)
    sizes[part[last] + 1] = upto[last]
    place = upto + np.cumsum(sizes)[part]  # of a part's cuts, in the whole order
    order = np.argsort(np.where(last, np.iinfo(np.int64).max, place), kind="stable")[: int((~last).sum())]
    at = np.searchsorted(place[order], total * np.arange(1, n) / n - step / 2)
    at = order[at[at < len(order)]]
    return ids[at], h[at]


def _shard_of(bounds: tuple[np.ndarray, np.ndarray], ids: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The shard of each (id, h). Rows equal to a bound that comes several times are dealt over its shards in turn."""
    low, high = (np.searchsorted(bounds[0], ids, side=x) for x in ("left", "right"))
    shard = low.copy()
    for i in np.flatnonzero(low < high).tolist():
        tied = bounds[1][low[i] : high[i]]
        a, z = (int(np.searchsorted(tied, h[i], side=x)) for x in ("left", "right"))
        shard[i] = low[i] + a + (i % (z - a) if z > a else 0)
    return shard.astype(np.int32)


def write_shards(docs: DataFrame, tokenizer: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Encode and write all documents; returns the manifest (shard, path, n_docs, n_tokens), itself a stored table.

    Ids are integers (what does not cast to one raises). Null texts are empty (their end id alone). Null ids come first and repeated ids stay side by side, each
    with its own ids. An empty table gives an empty manifest. Other columns are not read. A folder that is no URI is one of
    the cluster's default file system, which every node must share.
    """
    spark = docs.sparkSession
    folder = folder or store.new_path(spark, "tokens")
    where = _qualified(spark, folder)
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = text.bounded(docs).select(F.col(id_col).cast("bigint").alias("id"), body.alias("text"), F.xxhash64(body).alias("h"))
    bounds = spark.sparkContext.broadcast(_bounds(rows, shards))

    def encoded(batches):
        coder = Encoder.of(tokenizer)
        for b in text.pieces(batches, "text", 1 << 20):
            ids = b.column("id")
            h = b.column("h")
            shard = _shard_of(bounds.value, pc.fill_null(ids, int(_NONE)).to_numpy(), h.to_numpy())
            tokens = [t.tobytes() for t in coder.encode(b.column("text").to_pylist(), end)]
            yield pa.RecordBatch.from_arrays([pa.array(shard), ids, h, pa.array(tokens, pa.binary())], ["shard", "id", "h", "tokens"])

    def written(batches):
        width = Encoder.of(tokenizer).width
        now, stream, path, ends, ids, total = None, None, None, [], [], 0

        def finish():
            known = np.array([i for i in ids if i is not None], np.int64)
            first = int(known[0]) if len(known) else 0
            parts = [EliasFano.encode(np.array(ends)).to_bytes(), EliasFano.encode(known.view(np.uint64) - np.uint64(first % (1 << 64))).to_bytes()]
            foot = json.dumps({"docs": len(ids), "nulls": len(ids) - len(known), "first": first, "tokens": total, "width": width.itemsize, "ends": len(parts[0]), "ids": len(parts[1])}).encode()
            stream.write(parts[0] + parts[1] + foot + struct.pack("<I", len(foot)) + MAGIC)
            stream.close()
            return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "path": [path], "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

        for b in batches:
            for shard, doc, tokens in zip(b.column("shard").to_pylist(), b.column("id").to_pylist(), b.column("tokens"), strict=True):
                if shard != now:
                    if now is not None:
                        yield finish()
                    now, ends, ids, total = shard, [], [], 0
                    path = f"{where}/shard-{shard:06d}-{uuid.uuid4().hex}.bin"
                    system, name = _filesystem(path)
                    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    stream = system.open_output_stream(name)
                body = tokens.as_buffer()
                stream.write(body)
                total += body.size // width.itemsize
                ends.append(total)
                ids.append(doc)
        if now is not None:
            yield finish()
        text.tidy()

    dealt = rows.mapInArrow(encoded, "shard int, id bigint, h bigint, tokens binary").repartition("shard").sortWithinPartitions("shard", *_order())
    return store.stash(dealt.mapInArrow(written, "shard int, path string, n_docs bigint, n_tokens bigint"), "manifest")


class Shard:
    """One file, of which only the footer and the coded sequences are read: ``ends`` are the boundaries in ids."""

    def __init__(self, path: str) -> None:
        system, name = _filesystem(path)
        self.file = f = system.open_input_file(name)
        size = f.size()
        f.seek(size - 12)
        tail = f.read(12)
        if tail[-8:] != MAGIC:
            raise ValueError(f"{path} is no token shard")
        (n,) = struct.unpack_from("<I", tail)
        f.seek(size - 12 - n)
        self.foot = foot = json.loads(f.read(n))
        f.seek(foot["tokens"] * foot["width"])
        coded = f.read(foot["ends"] + foot["ids"])
        self.ends = EliasFano.from_bytes(coded[: foot["ends"]])
        self.known = EliasFano.from_bytes(coded[foot["ends"] :])

    def start(self, i: int) -> int:
        """Where document ``i`` begins."""
        return self.ends.select(i - 1) if i else 0

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from place ``first`` to ``last``, read from that part of the file."""
        width = self.foot["width"]
        self.file.seek(first * width)
        return np.frombuffer(self.file.read((last - first) * width), f"<u{width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.start(i), self.ends.select(i))

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        """Documents ``first`` to ``last``; None for a null id."""
        nulls = self.foot["nulls"]
        a, z = (max(0, x - nulls) for x in (first, last))
        known = (self.known.decode(a, z) + np.uint64(self.foot["first"] % (1 << 64))).view(np.int64).tolist()
        return [None] * (last - first - len(known)) + known


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone; start counts all ids before it."""

    def run(batches):
        for b in batches:
            for path, base, first, last in zip(*(b.column(c).to_pylist() for c in ("path", "base", "first", "last")), strict=True):
                shard = Shard(path)
                ends = shard.ends.decode(first, last).astype(np.int64)
                starts = np.concatenate([[shard.start(first)], ends[:-1]]).astype(np.int64)
                at = int(starts[0])
                wide = memoryview(shard.ids(at, int(ends[-1])).astype("<u4")).cast("B")
                crc = [zlib.crc32(wide[4 * a : 4 * z]) for a, z in zip((starts - at).tolist(), (ends - at).tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids(first, last), pa.int64()), "start": starts + base, "n_tokens": ends - starts, "ids_crc32": pa.array(crc, pa.int64())})

    order = W.orderBy("shard")  # one row for each file
    shards = manifest.withColumn("base", F.sum("n_tokens").over(order) - F.col("n_tokens"))
    first = F.explode(F.expr(f"sequence(0L, n_docs - 1, {RANGE}L)"))
    ranges = shards.select("path", "base", "n_docs", first.alias("first")).withColumn("last", F.least(F.col("first") + RANGE, "n_docs"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, "path", "first").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
