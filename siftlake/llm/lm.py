"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax, beside a smoothed unigram base.

P(word | history) = P(class | history) * P(word | class, history).

Classes. Training documents are clustered into ``TOPICS`` by their words: a pass over all of them counts the documents of each
hashed word, and in each of ``TOPIC_ROUNDS`` rounds all of them move the centres, which start from drawn directions and not from
documents. Every one is then assigned to a topic, and corpus counts of (word, topic) give each word the topic it is most often seen in. The most frequent words (at most ``HEAD``) have a
class by topic and frequency tier; the others a tail class by the topic of their last three bytes, learned from the same
counts, so unseen words have a class too. Three more classes: the end of the text, a repeat of the word before, and a repeat
of the word two before.

P(class | history) is a softmax over the classes; its features are hashed n-grams and skip-grams of the words and classes
before. Weights are fitted on all training documents, each once: in every round the tasks take their share of that round's
documents, step from the common weights, and the steps are averaged by rows of the weight table, in a shuffle.

P(word) = P(its class) * its share of the class by corpus counts, and the mass of a repeat class on top where the word is the
one before or two before. At a text's first words the repeat classes that have no word are left out of the softmax. Each tail
class keeps a share for one unseen word, as the base does. So the probabilities of all words, the unseen ones and the end sum
to one.

Corpus counts cover every training document and grow with it; words beyond the broadcast head are counted and looked up by
joins. Scores are computed in sparse numpy batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import store, text

TOPICS, TIERS = 8, 3  #: tiers of frequent words; the tail is one more
CLASSES = TOPICS * (TIERS + 1) + 3
END, SAME, SKIP = CLASSES - 3, CLASSES - 2, CLASSES - 1
HEAD = 1 << 20
ROWS = 1 << 15  #: rows of the hashed weight table
SUFFIXES = 1 << 12
TOPIC_BUCKETS = 1 << 11
TOPIC_ROUNDS = 5  #: rounds in which all training documents move the centres of the topics
END_HASH = np.uint64(0x656E64206F662074)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, suffix bucket, row) of every token, each text's end among them."""
    data, offsets = text.raw(column)
    data = text.LOWER[data]
    starts, ends, row = text.spans(data, offsets)
    h = text.hashes(data, starts, ends)
    suffix = (text.hashes(data, np.maximum(starts, ends - 3), ends) >> np.uint64(52)).astype(np.int64)
    n = len(offsets) - 1
    cut = np.searchsorted(row, np.arange(1, n + 1))
    return np.insert(h, cut, END_HASH), np.insert(suffix, cut, 0), np.insert(row, cut, np.arange(n))


def _topics(h: np.ndarray, row: np.ndarray, n: int, centres: np.ndarray) -> np.ndarray:
    """Topic of each text: the centre its words add up to most."""
    bucket = (h >> np.uint64(53)).astype(np.int64)
    begins = np.searchsorted(row, np.arange(n))
    return np.add.reduceat(centres[bucket], begins, axis=0).argmax(axis=1)


def _bags(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, log(1 + count)) of each text's hashed words."""
    key, count = np.unique((row.astype(np.int64) << 11) | (h >> np.uint64(53)).astype(np.int64), return_counts=True)
    return key >> 11, key & (TOPIC_BUCKETS - 1), np.log1p(count)


def _unit(columns: np.ndarray) -> np.ndarray:
    return columns / np.maximum(np.linalg.norm(columns, axis=0), 1e-9)


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bag of each text, as bytes: its hashed words' buckets and log(1 + count)."""
    for b in text.pieces(batches, "text"):
        h, _, row = _tokens(b.column("text"))
        own, bucket, value = _bags(h, row)
        cut = np.searchsorted(own, np.arange(b.num_rows + 1))
        kinds = (("bucket", bucket.astype("<u2")), ("value", value.astype("<f4")))
        packed = [pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((cut * x.itemsize).astype(np.int32)), pa.py_buffer(x.tobytes())]) for _, x in kinds]
        yield pa.RecordBatch.from_arrays(packed, [name for name, _ in kinds])


def _unbagged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, row, bucket, value) of stored bags, a few hundred texts at a time."""
    for whole in batches:
        for a in range(0, whole.num_rows, 256):
            b = whole.slice(a, 256)
            data, ends = text.raw(b.column("bucket").cast(pa.large_binary()))
            bucket = data.view("<u2").astype(np.int64)
            value = text.raw(b.column("value").cast(pa.large_binary()))[0].view("<f4").astype(float)
            yield b.num_rows, np.repeat(np.arange(b.num_rows), np.diff(ends) // 2), bucket, value
    text.tidy()


def _rarity(bags: DataFrame) -> np.ndarray:
    """The weight of each bucket, by the share of all documents that hold it."""

    def seen(batches):
        number = np.zeros(TOPIC_BUCKETS + 1, np.int64)
        for n, _, bucket, _ in _unbagged(batches):
            number[:-1] += np.bincount(bucket, minlength=TOPIC_BUCKETS)
            number[-1] += n
        yield pa.RecordBatch.from_pydict({"r": pa.array(np.arange(len(number)), pa.int32()), "n": pa.array(number)})

    number = np.zeros(TOPIC_BUCKETS + 1)
    for r, n in bags.mapInArrow(seen, "r int, n bigint").groupBy("r").agg(F.sum("n")).collect():  # a row for each bucket, and their total
        number[r] = n
    return np.log(max(1, number[-1]) / (1 + number[:-1]) + 1)


def _centres(bags: DataFrame, rarity: np.ndarray, seed: int = 11) -> np.ndarray:
    """(buckets, topics): spherical k-means of all documents."""
    centres = _unit(np.random.default_rng(seed).normal(size=(TOPIC_BUCKETS, TOPICS)))
    for _ in range(TOPIC_ROUNDS):

        def moved(batches, centres=centres):
            total, times = np.zeros((TOPICS, TOPIC_BUCKETS)), np.zeros(TOPICS)
            for n, own, bucket, value in _unbagged(batches):
                value = value * rarity[bucket]
                begins = np.searchsorted(own, np.arange(n))
                value /= np.maximum(np.sqrt(np.add.reduceat(value * value, begins)), 1e-9)[own]
                near = np.add.reduceat(centres[bucket] * value[:, None], begins, axis=0).argmax(axis=1)
                total += np.bincount(near[own] * TOPIC_BUCKETS + bucket, value, TOPICS * TOPIC_BUCKETS).reshape(total.shape)
                times += np.bincount(near, minlength=TOPICS)
            yield _rows(total / np.maximum(times, 1)[:, None], times)

        found, times = _summed(bags.mapInArrow(moved, "r int, n double, v binary"), TOPICS, TOPIC_BUCKETS)
        centres = np.where(times > 0, _unit(found.T), centres)
    return centres.astype(np.float32)


def _summed(rows: DataFrame, count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all tasks of a table's rows (r, n, v): v is n times a row of ``width`` floats. (sums, total n).

    Rows are added up where they meet by a shuffle; what reaches the driver is one table, whatever the number of tasks.
    """

    def add(batches):
        total, times = None, None
        for b in batches:
            if not b.num_rows:
                continue
            if total is None:
                total, times = np.zeros((count, width), np.float32), np.zeros(count)
            r = b.column("r").to_numpy()
            v = np.frombuffer(b"".join(b.column("v").to_pylist()), np.float32).reshape(-1, width)
            order = np.argsort(r, kind="stable")
            own, first = np.unique(r[order], return_index=True)
            total[own] += np.add.reduceat(v[order], first, axis=0)
            times[own] += np.add.reduceat(b.column("n").to_numpy()[order], first)
        if total is not None:
            own = np.flatnonzero(times)
            yield pa.RecordBatch.from_pydict({"r": pa.array(own, pa.int32()), "n": pa.array(times[own]), "v": pa.array([v.tobytes() for v in total[own]], pa.binary())})

    spark = rows.sparkSession
    dealt = rows.repartition("r")
    with store.cleaned(spark):
        got = dealt.mapInArrow(add, "r int, n double, v binary").toArrow()  # at most ``count`` rows
    sums, n = np.zeros((count, width), np.float32), np.zeros(count)
    at = got.column("r").to_numpy()
    if len(at):
        sums[at] = np.frombuffer(b"".join(got.column("v").to_pylist()), np.float32).reshape(-1, width)
        n[at] = got.column("n").to_numpy()
    return sums, n


def _rows(table: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    own = np.flatnonzero(n)
    v = (table[own] * n[own, None]).astype(np.float32)
    return pa.RecordBatch.from_pydict({"r": pa.array(own, pa.int32()), "n": pa.array(n[own].astype(float)), "v": pa.array([x.tobytes() for x in v], pa.binary())})


@dataclass
class Head:
    """The frequent words, by hash: class, log10(count + 0.1), and log10 of the word's share of its class."""

    h: np.ndarray
    cls: np.ndarray
    logc: np.ndarray
    share: np.ndarray
    suffix_class: np.ndarray
    tail_total: np.ndarray  # log10 of each class's smoothed mass, for tail classes

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)


def _prepared(h: np.ndarray, suffix: np.ndarray, row: np.ndarray, head: Head) -> tuple[np.ndarray, ...]:
    """Of each token: place in the head or -1, word class, class with repeats, features (tokens, 5), whether it repeats the word
    before and the one two before, and its place in the text."""
    words, inverse = np.unique(h, return_inverse=True)
    at = head.find(words)[inverse]
    word_class = np.where(at >= 0, head.cls[np.maximum(at, 0)] if len(head.h) else 0, head.suffix_class[suffix]).astype(np.int64)
    word_class[h == END_HASH] = END
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    # a text shorter than the history would leak its neighbour's words: blanks are set text by text
    start = np.repeat(first, np.diff(np.append(first, len(h))))
    age = np.arange(len(h)) - start

    def before(x, back, blank):
        out = np.full(len(x), blank, x.dtype)
        out[back:] = x[: max(0, len(x) - back)]
        out[age < back] = blank
        return out

    w1, w2 = before(h, 1, 1), before(h, 2, 2)
    c1, c2, c3, c4 = (before(word_class, k, CLASSES).astype(np.uint64) for k in (1, 2, 3, 4))
    same, skip = (h == w1) & (age >= 1), (h == w2) & (age >= 2)
    cls = np.where(same, SAME, np.where(skip, SKIP, word_class))
    n = np.uint64(CLASSES + 1)
    keys = (w1, text.mix(w1) ^ (w2 + np.uint64(3)), w2 ^ np.uint64(0x5851F42D4C957F2D), (c1 * n + c2) * n + c3 + np.uint64(1 << 40), (c2 * n + c4) * n + np.uint64(1 << 41))
    features = np.stack([(text.mix(k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.uint16) for k in keys], axis=1)
    return at, word_class, cls, features, same, skip, age


def _odds(weights: np.ndarray, features: np.ndarray, age: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the probability of every class is in proportion to, for each token, and its sum; a repeat of a word that is not
    there has none. Tokens are taken a few at a time, so that what is added up stays in a core's cache."""
    p = np.empty((len(features), weights.shape[1]), weights.dtype)
    more = np.empty((min(len(features), 1024), weights.shape[1]), weights.dtype)
    total = np.empty((len(features), 1), weights.dtype)
    for a in range(0, len(features), 1024):
        f, own, young = features[a : a + 1024], p[a : a + 1024], age[a : a + 1024]
        np.take(weights, f[:, 0], axis=0, out=own, mode="clip")
        for k in range(1, f.shape[1]):
            own += np.take(weights, f[:, k], axis=0, out=more[: len(f)], mode="clip")
        own[young < 1, SAME] = own[young < 2, SKIP] = -np.inf
        own -= own.max(axis=1, keepdims=True)
        np.exp(own, out=own)
        own.sum(axis=1, keepdims=True, out=total[a : a + 1024])
    return p, total


def _classes(weights: np.ndarray, features: np.ndarray, age: np.ndarray) -> np.ndarray:
    """Probability of every class for each token."""
    p, total = _odds(weights, features, age)
    p /= total
    return p


def _steps(weights: np.ndarray, cls: np.ndarray, features: np.ndarray, age: np.ndarray, rate: float, sums: np.ndarray, times: np.ndarray) -> None:
    """Adagrad over mini-batches, in place; ``times`` counts the uses of each row."""
    wide = features.shape[1]
    for a in range(0, len(cls), 4096):
        f, y = features[a : a + 4096], cls[a : a + 4096]
        p = _classes(weights, f, age[a : a + 4096])
        p[np.arange(len(y)), y] -= 1
        flat = f.ravel()
        order = np.argsort(flat, kind="stable")
        placed = flat[order]
        begins = np.flatnonzero(np.concatenate([[True], placed[1:] != placed[:-1]]))
        used = placed[begins].astype(np.int64)
        count = np.diff(np.append(begins, len(flat)))
        grad = p[order[begins] // wide]
        several = np.flatnonzero(count > 1)  # most features occur once and need no sum
        if len(several):
            own = p[order[np.repeat(count > 1, count)] // wide]
            grad[several] = np.add.reduceat(own, np.concatenate([[0], np.cumsum(count[several])[:-1]]), axis=0)
        times[used] += count
        sums[used] += (grad * grad).sum(axis=1) / CLASSES
        weights[used] -= rate * grad / np.sqrt(sums[used] + 1.0)[:, None]


def _terms(h: np.ndarray, suffix: np.ndarray, row: np.ndarray, head: Head, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each token: place in the head or -1, and its probability in the form log10(a) + log10(r + q * (c + 0.1)).

    c is the corpus count of a word outside the head, to be looked up; other tokens are in ``a`` alone (r = 1, q = 0).
    """
    at, word_class, _, features, same, skip, age = _prepared(h, suffix, row, head)
    own, again = np.empty(len(h)), np.empty(len(h))
    for b in range(0, len(h), 8192):
        z = min(b + 8192, len(h))
        p, total = _odds(weights, features[b:z], age[b:z])
        total = total[:, 0]
        own[b:z] = p[np.arange(z - b), word_class[b:z]] / total
        again[b:z] = np.where(same[b:z], p[:, SAME] / total, 0) + np.where(skip[b:z], p[:, SKIP] / total, 0)
    is_head, end = at >= 0, word_class == END
    share = 10.0 ** head.share[np.maximum(at, 0)] if len(head.h) else np.ones(len(h))
    rare = own / 10.0 ** head.tail_total[word_class]  # times (c + 0.1)
    known = is_head | end
    repeats = again > 0
    a = np.where(end, own, np.where(is_head, own * share + again, np.where(repeats, 1.0, rare)))
    r = np.where(known, 1.0, np.where(repeats, again, 0.0))
    q = np.where(known, 0.0, np.where(repeats, rare, 1.0))
    return at, np.log10(np.maximum(a, 1e-300)), r, q


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Documents with crc32(id as text) mod 10 = 0 are held out of all learning; a null id is not. Null texts are empty: their
    end is their one token. Repeated rows are scored each. An empty table gives an empty result; with no training document
    at all every word is unknown and the weights stay zero. Other columns are not read.
    """
    spark = docs.sparkSession
    ident = F.col(id_col)
    rows = text.bounded(docs).select(ident.alias("id"), F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 10 == 0, F.lit(False)).alias("held"), F.coalesce(text_col, F.lit("")).alias("text"))
    train = rows.where("NOT held")

    def third(k: int) -> DataFrame:
        """The training documents of round k."""
        return train.where(F.pmod(F.xxhash64("id", F.length("text")), F.lit(rounds)) == k).select("text")

    bags = store.stash(train.select("text").mapInArrow(_bagged, "bucket binary, value binary"), "bags")
    centres = _centres(bags, _rarity(bags))
    store.drop_stash(bags)

    def counted(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged():
            """(hash, topic, suffix, count), each (hash, topic) once."""
            h, t, s, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((t, h))
            h, t, s, c = h[order], t[order], s[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]))
            return h[first], t[first], s[first], np.add.reduceat(c, first)

        for b in text.pieces(batches, "text"):
            h, s, row = _tokens(b.column("text"))
            topic = _topics(h, row, b.num_rows, centres)[row]
            for k in np.unique(topic).tolist():
                own = topic == k
                word, first, count = np.unique(h[own], return_index=True, return_counts=True)
                held.append((word, np.full(len(word), k, np.int8), s[own][first].astype(np.int16), count))
                size += len(word)
            if size > 1_500_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield pa.RecordBatch.from_pydict(dict(zip(("h", "t", "s", "c"), (text.signed(held[0][0]), *held[0][1:]), strict=True)))
                    held, size = [], 0
        if held:
            h, t, s, c = merged()
            for a in range(0, len(h), 100_000):
                z = a + 100_000
                yield pa.RecordBatch.from_pydict({"h": text.signed(h[a:z]), "t": t[a:z], "s": s[a:z], "c": c[a:z]})

    counts = train.select("text").mapInArrow(counted, "h bigint, t tinyint, s smallint, c bigint")
    by_topic = [F.sum(F.when(F.col("t") == k, F.col("c")).otherwise(0)).alias(f"t{k}") for k in range(TOPICS)]
    words = counts.groupBy("h").agg(F.sum("c").alias("c"), F.min("s").alias("s"), *by_topic)
    most = F.greatest(*[F.col(f"t{k}") for k in range(TOPICS)])
    topic = F.coalesce(*[F.when(F.col(f"t{k}") == most, F.lit(k)) for k in range(TOPICS)]).cast("tinyint")
    words = store.stash(words.select("h", "c", "s", topic.alias("topic")), "words")

    end = int(END_HASH.astype(np.int64))
    total, distinct = (int(x or 0) for x in words.agg(F.sum("c"), F.count("*")).first())
    # a count above which at most HEAD words lie; counts are grouped by their leading bits, so few rows come back
    grade = F.expr("cast(floor(log2(c) * 64) as int)")
    steps = words.groupBy(grade.alias("g")).agg(F.count("*").alias("n")).orderBy(F.desc("g")).collect()
    least, sofar = None, 0
    for g, n in steps:
        if sofar + n > HEAD:
            break
        sofar, least = sofar + n, g
    frequent = words.where(grade >= (least if least is not None else 1 << 20))
    got = frequent.select("h", "c", "topic").toArrow()
    tail = words.where((grade < least) if least is not None else F.lit(True))
    per_suffix = words.where(F.col("h") != end).groupBy("s", "topic").agg(F.sum("c").alias("c")).toArrow()
    suffix_topic = np.zeros((SUFFIXES, TOPICS))
    suffix_topic[per_suffix.column("s").to_numpy().astype(np.int64), per_suffix.column("topic").to_numpy().astype(np.int64)] = per_suffix.column("c").to_numpy()
    suffix_topic = suffix_topic.argmax(axis=1)

    order = np.argsort(got.column("h").to_numpy().view(np.uint64))
    h = got.column("h").to_numpy().view(np.uint64)[order]
    c = got.column("c").to_numpy()[order].astype(float)
    t = got.column("topic").to_numpy()[order].astype(np.int64)
    by_count = np.empty(len(h), np.int64)
    by_count[np.argsort(-c, kind="stable")] = np.arange(len(h))
    tier = np.where(by_count < 64, 0, np.where(by_count < 2048, 1, 2))
    cls = np.where(h == END_HASH, END, t * (TIERS + 1) + tier)
    mass = np.bincount(cls, c, CLASSES)
    suffix_class = (suffix_topic * (TIERS + 1) + TIERS).astype(np.int64)
    tail_stats = {int(r[0]): (float(r[1]), float(r[2])) for r in tail.groupBy("s").agg(F.sum("c"), F.count("*")).collect()}  # a row for each suffix bucket at most
    tail_mass, tail_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for s, (m, n) in tail_stats.items():
        tail_mass[suffix_class[s]] += m
        tail_words[suffix_class[s]] += n
    head = Head(h, cls.astype(np.int16), np.log10(c + 0.1), np.log10(c / np.maximum(mass[cls], 1e-9)), suffix_class, np.log10(tail_mass + 0.1 * (tail_words + 1)))
    shared = spark.sparkContext.broadcast(head)

    weights = np.zeros((ROWS, CLASSES), np.float32)
    for k in range(rounds):
        now = spark.sparkContext.broadcast(weights)

        def fitted(batches, now=now, rate=0.5 / (1 + k)):
            own, sums, times = now.value.copy(), np.zeros(ROWS, np.float32), np.zeros(ROWS, np.int64)
            for b in text.pieces(batches, "text"):
                _, _, y, features, _, _, age = _prepared(*_tokens(b.column("text")), shared.value)
                _steps(own, y, features, age, rate, sums, times)
            if times.any():
                yield _rows(own - now.value, times)

        step, times = _summed(third(k).mapInArrow(fitted, "r int, n double, v binary"), ROWS, CLASSES)
        weights = weights + step / np.maximum(times, 1)[:, None].astype(np.float32)
        now.destroy()
    final = spark.sparkContext.broadcast(weights)

    def scored(batches):
        head, weights, number = shared.value, final.value, 0
        part = TaskContext.get().partitionId()
        for b in text.pieces(batches, "text"):
            h, suffix, row = _tokens(b.column("text"))
            at, p, r, q = _terms(h, suffix, row, head, weights)
            n = b.num_rows
            is_head = at >= 0
            base = np.where(is_head, head.logc[np.maximum(at, 0)] if len(head.h) else 0.0, 0.0)
            # words outside the head, to be looked up: the plain ones once for each text, with their number
            rare = np.flatnonzero(~is_head)
            order = np.lexsort((q[rare], r[rare], h[rare], row[rare]))
            rare = rare[order]
            new = np.ones(len(rare), bool)
            new[1:] = np.any([x[rare][1:] != x[rare][:-1] for x in (row, h, r, q)], axis=0)
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(rare))).astype(np.int32)
            own = rare[first]
            cut = np.searchsorted(row[own], np.arange(n + 1)).astype(np.int32)
            fields = [pa.array(text.signed(h[own])), pa.array(times), pa.array(r[own]), pa.array(q[own])]
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(fields, ["h", "n", "r", "q"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array((np.int64(part) << 40) + number + np.arange(n)), b.column("id"), b.column("held"), pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row, is_head, n).astype(np.int64)), pa.array(np.bincount(row, base, n)), pa.array(np.bincount(row, p, n)), lists],
                ["rid", "id", "held", "n_tokens", "known", "base", "model", "rare"],
            )
            number += n

    kind = docs.schema[id_col].dataType.simpleString()
    parts = store.stash(rows.mapInArrow(scored, f"rid bigint, id {kind}, held boolean, n_tokens bigint, known bigint, base double, model double, rare array<struct<h:bigint,n:int,r:double,q:double>>"), "scores")
    rare = parts.select("rid", F.explode("rare").alias("r")).select("rid", "r.*").join(tail.select("h", "c"), "h", "left")
    count = F.coalesce("c", F.lit(0)) + F.lit(0.1)
    sums = rare.groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(count)).alias("rare_base"),
        F.sum(F.col("n") * F.log10(F.col("r") + F.col("q") * count)).alias("rare_model"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
    )
    zero = F.lit(0.0)
    unit = float(np.log10(total + 0.1 * (distinct + 1)))
    return parts.drop("rare").join(sums, "rid", "left").select(
        "id",
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("model") + F.coalesce("rare_model", zero)).alias("score"),
    )
