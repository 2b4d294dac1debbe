"""The pipeline's stages against brute force, and on hostile rows."""

import random
import re

import corpus_pipeline
from siftlake.llm import near_dedup, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """The smallest id of each component of all pairs whose shingle sets are alike at 0.8 or more; no fingerprints, no keys."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)):
                label[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if r not in best or best[r] is None or (doc is not None and doc < best[r]):
            best[r] = doc
    return sorted(map(str, best.values()))


def edited(text, share, seed):
    rng = random.Random(seed)
    w = text.split(" ")
    for _ in range(max(1, int(share * len(w)))):
        w[rng.randrange(len(w))] = f"new{rng.random():.6f}"
    return " ".join(w)


def test_near_dedup_keeps_one_of_each_group(spark, documents, hostile, monkeypatch):
    base = [(r.doc_id, r.text) for r in documents.collect()]
    long = [t for _, t in base if len(t.split()) > 120][:6]
    copies = [(1000 + 10 * k + c, edited(t, 0.004 * (c + 1), 100 * k + c)) for k, t in enumerate(long) for c in range(6)]
    cloud = [(2000 + c, edited(long[0], 0.01, c)) for c in range(120)]
    far = [(3000 + c, edited(long[1], 0.025, c)) for c in range(60)]  # alike to few of the others: several components a key
    df = spark.createDataFrame(base + copies + cloud + far, "doc_id long, text string")
    want = brute_kept(base + copies + cloud + far)
    for block in (512, 7):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = sorted(str(r.doc_id) for r in near_dedup.deduplicate(df).collect())
        assert got == want
    got = near_dedup.deduplicate(hostile)
    assert got.columns == hostile.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == brute_kept([(r["doc_id"], r["text"]) for r in hostile.collect()])


def test_near_dedup_recall_by_similarity(spark):
    """Pairs of every kind of edit, binned by similarity: at least 0.99 of each bin from 0.8 on is found, and none below."""
    rng = random.Random(9)
    rows, similar = [], {}
    for k in range(700):
        w = [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(rng.randrange(30, 300))]
        n, share = len(w), rng.choice((0.02, 0.05, 0.1, 0.15, 0.2, 0.25))
        m, at = max(1, int(n * share)), rng.randrange(n // 2)
        block = [f"n{rng.randrange(10**6)}" for _ in range(m)]
        v = {0: w[: n - m], 1: w[m:], 2: w + block, 3: w[:at] + block + w[at + m // 2 :], 4: w[at:] + w[:at] + block, 5: edited(" ".join(w), share / 8, k).split()}[k % 6]
        a, b = " ".join(w), " ".join(v)
        s = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        similar[k] = s
        rows += [(2 * k, a), (2 * k + 1, b)]
    left = {r.doc_id for r in near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for lo, hi in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        own = [k for k, s in similar.items() if lo <= s < hi]
        assert len(own) > 30
        assert sum(2 * k + 1 not in left for k in own) >= 0.99 * len(own)
    assert all(2 * k + 1 in left for k, s in similar.items() if s < 0.8)


def test_near_dedup_of_cut_and_block_edited_copies(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        w = [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(rng.randrange(60, 400))]
        n, at = len(w), rng.randrange(len(w) // 2)
        block = [f"n{rng.randrange(10**6)}" for _ in range(n // 12)]
        kinds = (w[: n - n // 6], w[: n - n // 8], w[: n - n // 12], w[:at] + block + w[at + len(block) :], w + block, w[n // 3 :])
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(kinds[k % 6]))]
    want = brute_kept(rows)
    assert len(want) < 90
    assert sorted(str(r.doc_id) for r in near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_stages_in_turn(spark, sf_dir, hostile, none_at_all):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [re.findall("[0-9a-z]+", r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.collect()}
        if name == "pii":
            assert kept.count() == before.count()
            assert all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in kept.collect())
        else:
            assert kept.exceptAll(before).count() == 0
        if name == "benchmark decontamination":
            for r in before.collect():
                t = " ".join(re.findall("[0-9a-z]+", r.text.lower()))
                assert not (any(" ".join(b) in t for b in bench) and r.doc_id in ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
    for rows in (hostile, none_at_all):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, sf_dir).collect()


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert 0 < out.select("doc_id").distinct().count() < spark.read.parquet(f"{sf_dir}/documents.parquet").count()
