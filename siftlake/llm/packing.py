"""Best-fit packing by a grouping genetic algorithm (Falkenauer, 1996) on islands.

Pieces are dealt into blocks of a few thousand. Each block has ``ISLANDS`` populations of packings that evolve apart for an
epoch at a time; between epochs the best packing of each island migrates to the next one on a ring and takes the place of its
worst. Crossover injects whole well-filled bins of one parent into the other, drops the bins that hold the same pieces, and
best-fits the displaced pieces, largest first; mutation opens a few more bins, the emptiest and some at random. Packings are
judged by their number of bins, then by the mean square of the fills, which favours full bins and one empty rest.

Bins above the level's fill are final; the pieces of the others are pooled over all blocks and packed again, at a lower fill,
until one block or the last level is reached. So poorly filled bins of many blocks meet each other, and their number at the end
is that of a few blocks. A population is one row of arrays for each block and island, so an epoch shuffles only elites.
"""


from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import store, text
from siftlake.llm.tokens import Encoder

BLOCK = 4096  #: pieces in a block, about
ISLANDS = 3
EPOCHS = 3
GENERATIONS = 4  #: in an epoch
POPULATION = 4
WELL_FILLED = 0.999
LEVELS = (0.999, 0.97, 0.75, 0.0)  #: a bin filled that much is final


def cut(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with ``end`` after them, longer ones in pieces.

    A null text is empty. Rows are taken one by one, so null and repeated ids are packed like any other.
    """

    def run(batches):
        coder = Encoder.of(tokenizer)
        for b in text.pieces(batches, "text", 1 << 20):
            rows: list[tuple] = []
            for doc, ids in zip(b.column("id").to_pylist(), coder.encode(b.column("text").to_pylist(), end), strict=True):
                wide = memoryview(ids.astype("<u4")).cast("B")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    n = min(capacity, len(ids) - at)
                    rows.append((doc, k, at, n, zlib.crc32(wide[4 * at : 4 * (at + n)])))
            cols = list(zip(*rows, strict=True))
            kinds = [b.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text.bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class _Rooms:
    """Open bins by the room they have left, with the occupied rooms as one big integer: best fit is a shift and a bit."""

    def __init__(self, capacity: int, rooms: list[int]) -> None:
        self.capacity, self.mask, self.count = capacity, 0, len(rooms)
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        for k, room in enumerate(rooms):
            self._file(k, room)

    def _file(self, k: int, room: int) -> None:
        if room:
            self.by_room[room].append(k)
            self.mask |= 1 << room

    def place(self, size: int) -> int:
        """The bin that ``size`` fits best, a new one if it fits none."""
        fits = self.mask >> size
        if not fits:
            k, room = self.count, self.capacity
            self.count += 1
        else:
            room = size + (fits & -fits).bit_length() - 1
            k = self.by_room[room].pop()
            if not self.by_room[room]:
                self.mask &= ~(1 << room)
        self._file(k, room - size)
        return k


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int, bins: np.ndarray | None = None, rooms: np.ndarray | None = None) -> np.ndarray:
    """The bin of each piece: those of ``order`` are placed one by one into the bins given and new ones."""
    out = np.zeros(len(sizes), np.int32) if bins is None else bins.copy()
    open_ = _Rooms(capacity, [] if rooms is None else rooms.tolist())
    out[order] = [open_.place(n) for n in sizes[order].tolist()]
    return out


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then Falkenauer's mean squared fill."""
    fill = np.bincount(bins, sizes) / capacity
    return -len(fill), float((fill * fill).mean())


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator, opened: int = 3) -> np.ndarray:
    """A child of ``b`` with a draw of the well-filled bins of ``a`` injected whole, and ``opened`` bins opened by mutation."""
    fill_a, fill_b = np.bincount(a, sizes), np.bincount(b, sizes)
    good = fill_a >= WELL_FILLED * capacity
    if not good.any():
        good = fill_a >= np.sort(fill_a)[-max(1, len(fill_a) // 4)]
    chosen = good & (rng.random(len(good)) < 0.5)
    injected = chosen[a]
    broken = np.bincount(b, injected, len(fill_b)) > 0
    whole = np.flatnonzero(~broken)
    if len(whole):
        emptiest = whole[np.argsort(fill_b[whole], kind="stable")[:opened]]
        broken[emptiest] = True
        broken[rng.choice(whole, min(opened, len(whole)), replace=False)] = True
    kept = ~broken
    number_a, number_b = np.cumsum(chosen) - 1, np.cumsum(kept) - 1 + int(chosen.sum())
    stays = kept[b] & ~injected
    bins = np.where(injected, number_a[a], number_b[b]).astype(np.int32)
    rooms = (capacity - np.concatenate([fill_a[chosen], fill_b[kept]])).astype(np.int64)
    loose = np.flatnonzero(~injected & ~stays)
    return best_fit(sizes, loose[np.argsort(-sizes[loose], kind="stable")], capacity, bins, rooms)


def populate(sizes: np.ndarray, capacity: int, rng: np.random.Generator, count: int = POPULATION) -> list[np.ndarray]:
    """Best-fit packings of the pieces in several orders: descending, then more and more at random."""
    noise = [rng.uniform(1 - k / count, 1, len(sizes)) for k in range(count)]
    return [best_fit(sizes, np.argsort(-sizes * x, kind="stable"), capacity) for x in noise]


def evolve(population: list[np.ndarray], sizes: np.ndarray, capacity: int, rng: np.random.Generator, generations: int = GENERATIONS) -> list[np.ndarray]:
    """The population after an epoch, best first. It ends early only when no packing can be better: all bins but one are full."""
    judged = sorted(((fitness(x, sizes, capacity), k, x) for k, x in enumerate(population)), reverse=True, key=lambda j: j[:2])
    born = len(judged)
    for _ in range(generations):
        if (np.bincount(judged[0][2], sizes) < capacity).sum() <= 1:
            break
        best = judged[0][2]
        for _, _, other in judged[1:3] or judged:
            for a, b in ((best, other), (other, best)):
                child = crossover(a, b, sizes, capacity, rng)
                judged.append((fitness(child, sizes, capacity), born, child))
                born += 1
        judged = sorted(judged, reverse=True, key=lambda j: j[:2])[: len(population)]
    return [x for _, _, x in judged]


def pack(pieces: DataFrame, capacity: int = 4096, length_col: str = "length", block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``pieces`` with sequence_id and offset: sequences of at most ``capacity``, gapless from 0.

    Every row is one piece, whatever its other columns hold. Lengths must be 1 to ``capacity``; a null one raises. An empty table gives an
    empty result. Columns named sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    number = "__row"
    rest = pieces.select(*keep, F.monotonically_increasing_id().alias(number))
    rest = store.stash(rest.withColumn("__n", F.col(length_col).cast("int")), "pieces")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    state = "block int, island int, rows binary, sizes binary, population array<binary>"

    def settle(level: int):
        def run(df: pd.DataFrame) -> pd.DataFrame:
            """A block's islands with their first populations."""
            k = int(df["block"].iloc[0])
            df = df.sort_values(number)
            sizes = df["__n"].to_numpy(np.int32)
            first = [populate(sizes, capacity, np.random.default_rng((level, k, i))) for i in range(islands)]
            out = {"block": k, "island": range(islands), "rows": df[number].to_numpy(np.int64).tobytes(), "sizes": sizes.tobytes(), "population": [[x.tobytes() for x in own] for own in first]}
            return pd.DataFrame(out)

        return run

    def epoch(level: int, e: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    own = b.slice(r, 1)
                    sizes = np.frombuffer(own.column("sizes")[0].as_py(), np.int32)
                    population = [np.frombuffer(x, np.int32) for x in own.column("population")[0].as_py()]
                    rng = np.random.default_rng((level, e, own.column("block")[0].as_py(), own.column("island")[0].as_py(), 5))
                    after = [x.tobytes() for x in evolve(population, sizes, capacity, rng)]
                    at = b.schema.get_field_index("population")
                    yield own.set_column(at, "population", pa.array([after], pa.list_(pa.binary())))

        return run

    def placed(df: pd.DataFrame) -> pd.DataFrame:
        """The bin and place of each piece in the best packing of a block's islands."""
        sizes = np.frombuffer(df["sizes"].iloc[0], np.int32)
        elites = [np.frombuffer(p[0], np.int32) for p in df.sort_values("island")["population"]]
        bins = max(elites, key=lambda x: fitness(x, sizes, capacity))
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[order])
        fill = np.bincount(bins, sizes).astype(np.int64)
        at = np.empty(len(sizes), np.int64)
        at[order] = ends - sizes[order] - np.concatenate([[0], np.cumsum(fill)[:-1]])[bins[order]]
        rows = np.frombuffer(df["rows"].iloc[0], np.int64)
        return pd.DataFrame({number: rows, "__block": int(df["block"].iloc[0]), "__bin": bins, "__at": at, "__fill": fill[bins]})

    done = []
    count = rest.count()
    for level, least in enumerate(LEVELS):
        if not count:
            break
        blocks = -(-count // block)
        # dealt by a hash of stored row numbers: even whatever the keys are, and the same if a task runs again
        dealt = rest.select(number, "__n", F.pmod(F.xxhash64(number, F.lit(level)), F.lit(blocks)).cast("int").alias("block"))
        now = dealt.groupBy("block").applyInPandas(settle(level), state)
        for e in range(epochs):
            if e:  # the best of each island takes the place of the next island's worst
                guests = now.select("block", ((F.col("island") + 1) % islands).alias("island"), F.col("population")[0].alias("guest"))
                now = now.join(guests, ["block", "island"]).withColumn("population", F.expr("concat(slice(population, 1, size(population) - 1), array(guest))")).drop("guest")
            now = now.repartition(min(blocks * islands, 4 * partitions), "block", "island")
            now = store.stash(now.mapInArrow(epoch(level, e), state), "islands")
        packed = now.groupBy("block").applyInPandas(placed, f"{number} bigint, __block int, __bin int, __at bigint, __fill bigint")
        packed = store.stash(rest.join(packed, number), "packed")
        final = F.lit(True) if blocks == 1 else F.col("__fill") >= int(least * capacity)
        name = F.lit(level << 48).cast("bigint") + F.col("__block").cast("bigint") * (1 << 24) + F.col("__bin")
        done.append(packed.where(final).select(*keep, name.alias("sequence_id"), F.col("__at").alias("offset")))
        rest = packed.where(~final).select(*keep, number, "__n")
        count = 0 if blocks == 1 else rest.count()
    if not done:
        return pieces.select(*keep, F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return reduce(DataFrame.unionByName, done)
