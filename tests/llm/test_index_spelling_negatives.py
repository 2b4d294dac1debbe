"""Exact dedup through the digest index, spelling variants, and hard negatives, against brute force and on hostile rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from siftlake.llm import digest_index, hard_negatives, queries, spelling, text

# --- 11


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("which", ["documents", "hostile", "none_at_all"])
def test_exact_groups(which, request):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], normal(r["text"])) for r in df.collect()]
    ids = {}
    for i, t in rows:
        ids.setdefault(t, []).append(i)
    first = {t: min((i for i in x if i is not None), default=None) for t, x in ids.items()}
    want = sorted(str((i, first[t], len(ids[t]), hashlib.sha256(t.encode()).hexdigest())) for i, t in rows)
    got = digest_index.exact_groups(df).collect()
    assert sorted(str((r["id"], r["keep_id"], r["group_size"], r["digest"].hex())) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert Counter(bytes(r["digest"]) for r in kept) == Counter(hashlib.sha256(t.encode()).digest() for t in ids)
    assert all(r["id"] == r["keep_id"] for r in kept)


def test_index_lives_on_and_takes_only_what_is_new(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS digest", "1 AS row", "2 AS batch")
    index = digest_index.DigestIndex.create(spark, path=f"file://{tmp_path}/index", buckets=3)
    one = digest_index.deduplicate(make((4, "a b"), (2, "a\n b"), (2, "a\n b"), (None, "c"), (7, None), (8, "")), index)
    assert sorted(map(str, ((r.doc_id, r.text) for r in one.collect()))) == sorted(map(str, [(2, "a\n b"), (None, "c"), (7, None)]))
    again = digest_index.DigestIndex.open(spark, f"file://{tmp_path}/index")
    two = digest_index.deduplicate(make((1, "a b"), (3, "d"), (9, "d "), (5, "c")), again)
    assert [(r.doc_id, r.text) for r in two.orderBy("doc_id").collect()] == [(3, "d"), (9, "d ")]
    assert two.columns == ["doc_id", "text", "digest", "row", "batch"]
    assert digest_index.deduplicate(make((3, "d")), again).count() == 0
    small = again.compacted()
    assert sorted(map(str, small.read().collect())) == sorted(map(str, again.read().collect()))
    assert small.read().count() == 5


def test_index_is_joined_by_bucket(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = digest_index.DigestIndex.create(spark, buckets=4)
        rows = digest_index.digests(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
        index.add(rows)
        plan = rows.hint("merge").join(index.read(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # of the new side alone
    assert "Bucketed: true" in plan


# --- 12


def brute_vocabulary(rows, corrupt):
    counts = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if corrupt and h % corrupt == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_group(words):
    near = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words:
        for n in (len(w) - 1, len(w), len(w) + 1):
            near[w] += [v for v in by_length.get(n, []) if one_edit(w, v)]
    form = {}
    for w, x in near.items():
        best = min(x, key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("which", ["documents", "hostile", "none_at_all"])
def test_spelling_variants(which, request):
    df = request.getfixturevalue(which)
    words = brute_vocabulary([(r["doc_id"], r["text"]) for r in df.collect()], 97)
    got = [tuple(r) for r in spelling.variants(df, corrupt=97).collect()]
    assert sorted(map(str, got)) == brute_group(words)


def test_one_edit_in_every_place_and_length(spark):
    rng = np.random.default_rng(5)
    words = {}
    for n in (5, 6, 9, 30, 31, 32, 33, 34, 130, 700):
        for letters in ("ab", "xyzé"):
            for _ in range(6):
                w = "".join(rng.choice(list(letters), n))
                k = int(rng.integers(n))
                for v in (w, w[:k] + w[k + 1 :], w[:k] + "q" + w[k:], w[:k] + "r" + w[k + 1 :], w[:k] + w[k:][:1] + w[k:], w + "s", "t" + w):
                    words[v] = int(rng.integers(3, 60))
    words |= {"a" * n: n for n in (5, 6, 7, 31, 32, 33, 34, 400, 401)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = [tuple(r) for r in spelling.group(df).collect()]
    assert sorted(map(str, got)) == brute_group(words)


def test_forms_lead_through_a_long_chain_to_the_root(spark):
    words = {"abcdefghijk"[:k] + "zzzzz": 3 * 2**k for k in range(12)}
    words |= {"b" + "zzzzz": 6}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(str(tuple(r)) for r in spelling.group(df).collect()) == brute_group(words)


def test_crcs_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts = np.array([0, 5, 5, 100, 700, 2999, 40])
    ends = np.array([5, 5, 6, 700, 2999, 3000, 296])
    begun = np.array([zlib.crc32(b"%d:" % i) for i in range(7)], np.uint32)
    want = [zlib.crc32(b"%d:" % i + data[a:z].tobytes()) for i, (a, z) in enumerate(zip(starts, ends, strict=True))]
    assert spelling._crcs(data, starts, ends, begun).tolist() == want
    assert text.LOWER[65] == 97


# --- 13


def brute_negatives(rows, wide):
    fine = []
    for i, label, x in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        fine.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(v)) for v in x] + [0] * (wide - len(x))))
    out = []
    for i, label, x in {(i, c, tuple(x)) for i, c, x in fine if i % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, c) for j, c, y in fine)
        for s, j, _ in [t for t in scored if t[2] == label and t[1] != i][:5]:
            fits = [t for t in scored if t[2] != label and 30 * -s <= 100 * -t[0] <= 90 * -s][:10]
            out += [(i, j, k + 1, v, -s, -t) for k, (t, v, _) in enumerate(fits)]
    return sorted(map(str, out))


def hostile_vectors():
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(3)), (rng.normal(size=4) + 0.6).astype(float).tolist()) for i in range(400)]
    rows += [(500, 1, [0.25, 0.5, 0.5, 0.5])] * 2 + [(501, 1, [0.25, 0.5, 0.5, 0.5]), (502, 1, [0.25, 0.5, 0.5, 0.5])]
    rows += [(None, 1, [1.0] * 4), (600, None, [1.0] * 4), (700, 1, None), (800, 1, [1.0, None, 1.0, 1.0]), (900, 1, [1.0, float("nan"), 0.0, 0.0]), (901, 2, [float("inf"), 0.0, 0.0, 0.0])]
    return [*rows, (1000, 2, [0.0] * 4), (1001, 2, []), (1100, 1, [2.0]), (1200, 9, [1.0] * 4), (1300, 2, [3e6, 2e6, 1.0, 0.0]), (1301, 2, [2e6, 1e6, 1.0, 0.0]), (1302, 1, [1e6, 1e6, 1.0, 0.0])]


@pytest.mark.parametrize("block", [3, 1024])
def test_hard_negatives(spark, sf_dir, block, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "PASS", 2)
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    for data, wide in ((hostile_vectors(), 4), (given, 64)):
        df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS id", "2 AS x", "3 AS rank", "4 AS block")
        rows = hard_negatives.rows_of(df, flip=7)
        got = [tuple(r) for r in hard_negatives.mine(rows, rows.where("id % 100 = 0")).collect()]
        want = brute_negatives(data, wide)
        assert want
        assert sorted(map(str, got)) == want


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    rows = hard_negatives.rows_of(df, flip=7)
    assert hard_negatives.mine(rows, rows).collect() == []


def test_tree_bounds_hold_and_skip_rows():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 16)) * 400
    anchors = np.floor(np.repeat(centres, 12, axis=0) + rng.normal(size=(72, 16)) * 4)
    order, parent, edge = hard_negatives.spanning_tree(anchors)
    assert all(p < k for k, p in enumerate(parent))
    total = sum(edge)
    d = np.sqrt(((anchors[:, None] - anchors[None]) ** 2).sum(axis=2))
    seen, near, want = [0], d[0].copy(), 0.0  # the weight of a minimum spanning tree
    while len(seen) < 72:
        near[seen] = np.inf
        i = int(np.argmin(near))
        want += near[i]
        seen.append(i)
        near = np.minimum(near, d[i])
    assert math.isclose(total, want)
    tree = hard_negatives.Tree(0, np.arange(72), np.zeros(72), anchors[order], parent, edge)
    rows = np.floor(rng.normal(size=(500, 16)) * 300)
    true = rows @ tree.vectors.T
    scored = 0

    def wanted(k, low, high):
        assert (low <= true[:, k]).all()
        assert (true[:, k] <= high).all()
        return high >= 1_500_000

    for k, at, scores in hard_negatives.walk(tree, rows, wanted):
        scored += len(at)
        assert scores.tolist() == true[at, k].tolist()
    assert scored < 0.5 * 72 * 500


@pytest.mark.parametrize("name", ["op11_digest_index", "op13_anchor_tree_negatives"])
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = queries.QUERIES[name](spark, folder)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(map(str, df.select(*want.columns).collect())) == sorted(map(str, (df.sparkSession.createDataFrame(want.fetchall(), df.select(*want.columns).schema)).collect()))
