"""Each operator against brute force on a small table and on hostile rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from siftlake.llm import chunk_dedup, components, decontaminate, elias_fano, line_quality, lm, packing, pii, queries, simhash, suffix_dedup, text, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def both(documents, hostile):
    return [documents, hostile]


# --- 1


def brute_fp(t, n=3):
    w = WORD.findall(lower(t))
    if not w:
        return 0
    sh = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, ids, radius):
    n = len(fps)
    f = np.array(fps, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    label = list(range(n))
    while True:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(n)]
        if new == label:
            break
        label = new
    least = defaultdict(list)
    for x, i in zip(label, ids, strict=True):
        if i is not None:
            least[x].append(i)
    return [min(least[x]) if least[x] else None for x in label]


@pytest.mark.parametrize("which", ["documents", "hostile"])
def test_simhash_groups(which, request):
    df = request.getfixturevalue(which)
    rows = rows_of(df)
    fps = [brute_fp(t) for _, t in rows]
    want = sorted(map(str, zip([i for i, _ in rows], fps, brute_groups(fps, [i for i, _ in rows], 2), strict=True)))
    got = sorted(str((r["id"], r["fp"] % (1 << 64), r["component_id"])) for r in simhash.near_groups(df).collect())
    assert got == want


@pytest.mark.parametrize(("radius", "segments", "chain"), [(2, 3, 2), (2, 3, 1), (7, 4, 1), (4, 3, 1), (3, 4, 1)])
def test_ring_pairs_lose_nothing(spark, radius, segments, chain):
    v = np.unique(np.random.default_rng(radius).integers(0, 1 << 11, 700).astype(np.int64) * 0x0040100401004011)
    fps = spark.createDataFrame([(int(x),) for x in v], "fp long")
    d = np.bitwise_count(v.view(np.uint64)[:, None] ^ v.view(np.uint64)[None, :])
    want = {(int(min(v[i], v[j])), int(max(v[i], v[j]))) for i, j in zip(*np.nonzero((d > 0) & (d <= radius)), strict=True)}
    got = [(r.a, r.b) for r in simhash.ring_pairs(fps.selectExpr("fp AS id", "fp"), radius, segments, chain).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_ring_pairs_send_no_listing_to_all_tasks(spark, tmp_path):
    spark.range(2000).selectExpr("xxhash64(id) AS id", "xxhash64(id) AS fp").write.parquet(str(tmp_path / "points"))
    pairs = simhash.ring_pairs(spark.read.parquet(str(tmp_path / "points")), 2, 3, 2)
    pairs.collect()
    assert "Broadcast" not in pairs._jdf.queryExecution().toString()


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(None, 3), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7} | {i: 7 for i in range(200, 400)}


# --- 2


def test_lm_base_is_exact_and_the_model_beats_it(documents, hostile):
    for df in (documents, hostile):
        rows = rows_of(df)
        toks = [[*WORD.findall(lower(t)), None] for _, t in rows]
        held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
        c = Counter(w for own, h in zip(toks, held, strict=True) if not h for w in own)
        n, v = sum(c.values()), len(c)
        want = sorted((str(i), h, len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 4)) for (i, _), h, own in zip(rows, held, toks, strict=True))
        got = lm.score(df).collect()
        assert sorted((str(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
        if df is documents:
            out = [r for r in got if r["held_out"]]
            assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_topics_come_from_all_training_documents(spark):
    """With one gradient round no part of the model depends on ids: other ids for the same rows, held out alike, give the same scores."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k % 9}x{x}" for x in rng.integers(0, 60, rng.integers(5, 40))) for k in range(1500)]
    trained = [i for i in range(10_000) if not lm.held_out(i)]
    scores = []
    for ids in (trained[:1500], trained[3000:4500][::-1]):
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").coalesce(1)
        got = {r["id"]: r["score"] for r in lm.score(df, rounds=1).collect()}
        scores.append([got[i] for i in ids])
    assert np.allclose(*scores, rtol=1e-3)


def test_lm_centres_are_k_means_of_every_bag(spark, documents):
    """Weights of buckets and centres against the plain computation over all rows."""
    texts = documents.selectExpr("text").repartition(3)
    bags = texts.mapInArrow(lm._bagged, "bucket binary, value binary").localCheckpoint()
    rows = bags.collect()
    x = np.zeros((len(rows), lm.TOPIC_BUCKETS))
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r.bucket, "<u2")] = np.frombuffer(r.value, "<f4")
    assert np.isclose(np.expm1(x).sum(), sum(len(WORD.findall(t)) + 1 for _, t in rows_of(documents)))
    rarity = lm._rarity(bags)
    assert np.allclose(rarity, np.log(len(x) / (1 + (x > 0).sum(axis=0)) + 1))
    x *= rarity
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = lm._unit(np.random.default_rng(11).normal(size=(lm.TOPIC_BUCKETS, lm.TOPICS)))
    for _ in range(lm.TOPIC_ROUNDS):
        near = (x @ centres).argmax(axis=1)
        centres = np.stack([x[near == k].mean(axis=0) if (near == k).any() else centres[:, k] for k in range(lm.TOPICS)], axis=1)
        centres /= np.linalg.norm(centres, axis=0)
    assert np.allclose(lm._centres(bags, rarity), centres, atol=1e-3)


def test_lm_probabilities_sum_to_one():
    """Over all words of a small vocabulary, one unseen word of each tail class, and the end; histories with repeats too."""
    rng = np.random.default_rng(1)
    vocabulary = [f"w{k}x{rng.integers(10**6)}" for k in range(80)]
    hashed = {w: lm._tokens(pa.array([w], pa.large_string())) for w in [*vocabulary, *(f"new{k}" for k in range(400))]}
    h = {w: x[0][0] for w, x in hashed.items()}
    suffix = {w: x[1][0] for w, x in hashed.items()}
    count = {w: int(rng.integers(1, 50)) for w in vocabulary}
    suffix_class = rng.integers(0, lm.TOPICS, lm.SUFFIXES) * (lm.TIERS + 1) + lm.TIERS
    frequent = sorted(vocabulary[:40], key=lambda w: h[w])
    cls = rng.integers(0, lm.TOPICS, 40) * (lm.TIERS + 1) + rng.integers(0, lm.TIERS, 40)
    cls[0] = lm.END
    keys, numbers = np.array([h[w] for w in frequent], np.uint64), np.array([float(count[w]) for w in frequent])
    keys[0] = lm.END_HASH
    order = np.argsort(keys)
    keys, numbers, cls = keys[order], numbers[order], cls[order]
    frequent = [w for w in frequent if h[w] in set(keys.tolist())]
    mass = np.bincount(cls, numbers, lm.CLASSES)
    tail = vocabulary[40:]
    tail_mass, tail_words = np.zeros(lm.CLASSES), np.zeros(lm.CLASSES)
    for w in tail:
        tail_mass[suffix_class[suffix[w]]] += count[w]
        tail_words[suffix_class[suffix[w]]] += 1
    head = lm.Head(keys, cls.astype(np.int16), np.log10(numbers + 0.1), np.log10(numbers / mass[cls]), suffix_class, np.log10(tail_mass + 0.1 * (tail_words + 1)))
    used = {int(c) for c in cls}
    weights = rng.normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32)
    empty = [k for k in range(lm.CLASSES - 3) if k not in used and k % (lm.TIERS + 1) != lm.TIERS]
    weights[:, empty] = -50  # frequent classes without words
    unseen = {}
    for w in h:
        if w.startswith("new") and w != "new9":
            unseen.setdefault(int(suffix_class[suffix[w]]), w)
    assert len(unseen) == lm.TOPICS
    for history in ([], [frequent[3]], [frequent[3], frequent[4]], [frequent[5], frequent[5]], [tail[0], tail[1]], [tail[2], tail[2]], [frequent[6], tail[3]], ["new9", tail[4]]):
        total = 0.0
        for w in [*frequent, *tail, *unseen.values(), None]:
            column = pa.array([" ".join(history + ([w] if w else []))], pa.large_string())
            _, p, r, q = lm._terms(*lm._tokens(column), head, weights)
            total += 10 ** p[len(history)] * (r[len(history)] + q[len(history)] * (count.get(w, 0) + 0.1))
        if "new9" in history:  # an unseen word that repeats has its repeat's mass besides its class's share
            column = pa.array([" ".join([*history, "new9"])], pa.large_string())
            _, p, r, _ = lm._terms(*lm._tokens(column), head, weights)
            total += 10 ** p[2] * r[2]
        assert abs(total - 1) < 1e-4, (history, total)


# --- 3

BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def brute_base(t):
    out = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(t) if ok(m[0])]
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(out))


HARD = [
    "a@b.c@d.ef x@@y.z .@a.b a@b a.b-c%d+e@host.x-y.z.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 9.9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1111, 4111  1111 1111 1111 79927398713 5500005555555559",
    "+1 (017) 555-7713 +12 +1234567890123456 ++49 30 123456. +4 )(.-9",
    "a@b.c_x@d.e%@f.g é@ä.b ü+1 555 123 4567 x",
    "9" * 3000 + "." + "1" * 2000,
]


def test_pii_base_spans():
    for t in HARD:
        assert pii.written(pii.base_spans(t)) == brute_base(t), t


def test_pii_query_on_tables(spark, sf_dir, documents):
    want = {i: brute_base(t) for i, t in rows_of(documents)}
    for r in queries.op3_crf_pii(spark, sf_dir).collect():
        base = want[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [base.count(f"{k}:") for k in pii.KINDS]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_field_on_forms_that_were_not_learned():
    """Precision and recall of whole spans, on 4,800 rows drawn with another seed."""
    model = pii.train(pii.labelled_table())
    hit, wrong, lost = np.zeros(4), np.zeros(4), np.zeros(4)
    rows = pii.labelled_table(4800, seed=91)
    texts = [" ".join([*before, *run, after]) for before, run, after, _ in rows]
    for t, (before, run, _, labels), got in zip(texts, rows, pii.field_spans(texts, model), strict=True):
        want, at = [], len(" ".join(before)) + 1
        for w, tag in zip(run, labels, strict=True):
            end = at + len(w.rstrip(".,;"))
            if tag[0] == "B":
                want.append((at, end, pii.KINDS.index(tag[2:])))
            elif tag[0] == "I":
                want[-1] = (want[-1][0], end, want[-1][2])
            at += len(w) + 1
        for k in range(4):
            a, b = ({s for s in x if s[2] == k} for x in (got, want))
            hit[k], wrong[k], lost[k] = hit[k] + len(a & b), wrong[k] + len(a - b), lost[k] + len(b - a)
    assert (hit / (hit + wrong)).min() >= 0.97 and (hit / (hit + lost)).min() >= 0.97


@pytest.mark.parametrize("t, kinds", [
    ("see page 100-200-3000 now", []), ("order 100-200-3000 came", []), ("run v1.2.3.4:8080 up", []), ("version 10.2.3.4-beta is out", []),
    ("call me on 212-555-0199 now", ["phone"]), ("host 10.0.0.3:8080 is up", ["ip"]), ("phone " + " " * 500 + "(212) 555-0199", ["phone"]),
])
def test_field_on_look_alikes(t, kinds):
    assert [pii.KINDS[k] for _, _, k in pii.field_spans([t], pii.train(pii.labelled_table()))[0]] == kinds


def test_spans_are_merged_like_the_plain_rule():
    rng = np.random.default_rng(6)
    for _ in range(200):
        base = sorted((int(a), int(a + rng.integers(1, 30)), int(rng.integers(4))) for a in rng.integers(0, 300, rng.integers(0, 12)))
        more = [(int(a), int(a + rng.integers(1, 30)), int(rng.integers(4))) for a in rng.integers(0, 300, rng.integers(0, 12))]
        new = [s for s in more if not any(a < s[1] and b > s[0] for a, b, _ in base)]
        assert pii.all_spans(base, more) == sorted([*base, *new], key=lambda s: (s[0], s[2]))


def test_words_about_a_run_are_whole():
    long = "x" * 5000
    assert pii._words_before(f"{long} {long} 12", 10002) == (long, long)
    assert pii._words_before("a  12", 3) == ("", "a") and pii._words_before("12", 0) == ("", "")
    assert pii._word_after(f"12 {long} y", 2) == long and pii._word_after("12", 2) == ""
    assert pii.word_features("1" + long)[0] == "w:da"


def test_pii_hostile(hostile, none_at_all):
    got = pii.find(hostile).collect()
    assert len(got) == hostile.count()
    assert sorted(str(r["id"]) + r["base"] for r in got) == sorted(str(i) + brute_base(t) for i, t in rows_of(hostile))
    assert pii.find(none_at_all).count() == 0


def test_field_finds_what_patterns_miss_and_leaves_numbers_alone():
    model = pii.train(pii.labelled_table())
    texts = ["call me, tel 017-555-7713 now", "phone (212) 555-0182, please", "visa 4111.1111.1111.1111 ok", 'token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72" x', "version 2.0. and CC BY-NC 4.0.", "on 2024-01-05 at 12:30 we sold 1,024 for $12.50", "order 4952935900253053 came"]
    found = [[pii.KINDS[k] for _, _, k in own] for own in pii.field_spans(texts, model)]
    assert found == [["phone"], ["phone"], ["card"], [], [], [], []]


def test_field_decodes_the_best_path():
    rng = np.random.default_rng(2)
    m = pii.Field({}, np.zeros((0, 9)), rng.normal(size=(9, 9)), rng.normal(size=9))
    s = rng.normal(size=(6, 3, 9))
    paths = [(a, b, c) for a in range(9) for b in range(9) for c in range(9)]
    for k, got in enumerate(m.decode(s)):
        score = [m.first[a] + s[k, 0, a] + m.move[a, b] + s[k, 1, b] + m.move[b, c] + s[k, 2, c] for a, b, c in paths]
        assert tuple(got) == paths[int(np.argmax(score))]


def test_redaction():
    t = "mail a.b@c.de or +1 (017) 555-7713."
    assert pii.redact(t, pii.base_spans(t)) == "mail [EMAIL] or [PHONE]."


# --- 4 and 7


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.default_path()


def test_encoder_equals_the_library(documents, hostile, tokenizer):
    e = tokens.Encoder(tokenizer)
    odd = ["x<|endoftext|>'s a <|startoftext|>", "É'S ΟΔΟΣ² İI _a_ a b \x1cq\x1dr it's_ '' \"'s  don'T ½ 123abc", "", " \n", "日本語 テキスト🙂a", "á éx ́y"]
    for t in [t for _, t in rows_of(documents) + rows_of(hostile)] + odd:
        assert e.encode([t], 2)[0].tolist() == [*e.model.encode(t, add_special_tokens=False).ids, 2]


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (1, 10**12), (1000, 50), (3000, 10**6), (700, 10**15)):
        v = np.sort(rng.integers(0, top, n))
        e = elias_fano.EliasFano.from_bytes(elias_fano.EliasFano.encode(v).to_bytes())
        assert e.decode().tolist() == v.tolist()
        assert [e.select(i) for i in range(0, n, 13)] == v[::13].tolist()
        for a, z in ((0, n), (n // 3, n // 2), (n // 2, n), (255, 257), (256, 512)):
            assert e.decode(a, min(z, n)).tolist() == v[a : min(z, n)].tolist()
        if n > 500:
            assert 8 * len(e.to_bytes()) / n < 2.6 + max(0, math.log2(max(1, top / n))) + 8 * 33 / n


@pytest.mark.parametrize("which", ["documents", "hostile", "none_at_all"])
def test_token_shards(which, request, tokenizer, monkeypatch):
    df = request.getfixturevalue(which)
    e, rows = tokens.Encoder(tokenizer), rows_of(df)
    monkeypatch.setattr(elias_fano, "SHARD_BYTES", 50_000)
    monkeypatch.setattr(elias_fano, "RANGE", 7)
    manifest = elias_fano.write_shards(df, tokenizer, end=2)
    got = elias_fano.read_shards(manifest).orderBy("start").collect()
    for f in manifest.collect():
        shard = elias_fano.Shard(f.path)
        for i in range(0, f.n_docs, 3):
            assert len(shard.document(i)) == shard.ends.select(i) - shard.start(i)
    if which == "documents":
        assert manifest.count() > 5
    by_id = defaultdict(list)
    for i, t in rows:
        ids = e.encode([t], 2)[0].astype("<u4")
        by_id[i].append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        assert (r["n_tokens"], r["ids_crc32"]) in by_id[r["doc_id"]]
        at += r["n_tokens"]


def test_shards_hold_even_shares_of_bytes(spark, tokenizer, monkeypatch):
    """Long documents with small ids, an id that many rows share, and null ids."""
    monkeypatch.setattr(elias_fano, "SHARD_BYTES", 40_000)
    rows = [(i, "word " * 1500) for i in range(40)] + [(i, "word word") for i in range(40, 2000)]
    rows += [(5000, "word " * 40 + str(k)) for k in range(1500)] + [(5001, "word " * 40)] * 1000 + [(None, "word " * 50 + str(k)) for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = elias_fano.write_shards(df, tokenizer, end=2)
    total = sum(len(t) + 1 for _, t in rows)
    shares = sorted(r.n_tokens for r in manifest.collect())
    assert len(shares) >= 0.8 * total / 40_000
    assert shares[-1] <= 2 * np.median(shares)
    got = elias_fano.read_shards(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    e = tokens.Encoder(tokenizer)
    crcs = {t: zlib.crc32(e.encode([t], 2)[0].astype("<u4").tobytes()) for t in {t for _, t in rows}}
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((i, crcs[t]) for i, t in rows)


def test_each_new_part_goes_once_through_the_pair_model_alone(tokenizer, monkeypatch):
    """Every Latin-1 letter, contractions, digits and signs; a part that was seen, in this call or before, is not encoded again."""
    e = tokens.Encoder(tokenizer)
    letters = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
    texts = [" ".join(letters) + " don't x'' 'S 12 a-b", f"{letters} ~!{letters[::-1]}\t" + "Word word, " * 50, "long" * 30 + " word"]
    want = [[*e.model.encode(t, add_special_tokens=False).ids, 7] for t in texts]
    asked = []

    class Pairs:
        def tokenize(self, part, model=e.pairs):
            asked.append(part)
            return model.tokenize(part)

    monkeypatch.setattr(e, "pairs", Pairs())
    assert [x.tolist() for x in e.encode(texts, 7)] == want
    assert len(asked) == len(set(asked))
    kept = len(asked)
    monkeypatch.setattr(tokens, "CACHED_PARTS", 10)
    assert [x.tolist() for x in e.encode(texts, 7)] == want
    assert set(asked[kept:]) == {p for p in asked if len(p) > tokens.CACHED_CHARS}
    assert len(e.parts) <= 10


def test_a_folder_without_a_scheme_is_of_the_default_file_system(spark):
    assert elias_fano._qualified(spark, "/some/where") == "file:///some/where"
    assert elias_fano._qualified(spark, "file:///some/where") == "file:///some/where"


@pytest.mark.parametrize("which", ["documents", "hostile", "none_at_all"])
def test_packing(which, request, tokenizer):
    df = request.getfixturevalue(which)
    e = tokens.Encoder(tokenizer)
    want = Counter()
    for i, t in rows_of(df):
        ids = e.encode([t], 1)[0].astype("<u4")
        want.update((i, k // 512, k, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512].tobytes())) for k in range(0, len(ids), 512))
    got = packing.pack(packing.cut(df, tokenizer, 512), 512, block=150).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 512
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 512) * 1.02 + 1


def test_packing_of_pieces_that_never_pair(spark):
    df = spark.createDataFrame([(i, 300) for i in range(500)], "doc_id long, length long")
    df = df.selectExpr("*", "1 AS block", "2 AS bin", "3 AS at", "4 AS fill", "5 AS island", "6 AS rows", "7 AS offset", "8 AS sequence_id", "9 AS population")
    packed = packing.pack(df, 512, block=100)
    got = packed.collect()
    assert len(got) == 500
    assert set(packed.columns) == set(df.columns)
    assert {(r.block, r.bin, r["at"], r.fill, r.island, r.rows) for r in got} == {(1, 2, 3, 4, 5, 6)}
    assert len({r.sequence_id for r in got}) == 500


def fewest_bins(sizes, capacity):
    """The exact optimum, by trying every bin for each piece."""
    best = [len(sizes)]

    def put(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for r in sorted({x for x in rooms if x >= sizes[k]}):
            i = rooms.index(r)
            put(k + 1, [*rooms[:i], r - sizes[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, capacity - sizes[k]])

    put(0, [])
    return best[0]


def test_islands_reach_the_optimum_of_small_cases(spark):
    rng = np.random.default_rng(44)
    for k in range(25):
        sizes = sorted(rng.integers(12, 60, 11).tolist(), reverse=True)
        df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, length long")
        if k < 3:  # through Spark
            assert len({r.sequence_id for r in packing.pack(df, 100).collect()}) == fewest_bins(sizes, 100)
        s = np.array(sizes, np.int32)
        pools = [packing.populate(s, 100, np.random.default_rng((k, i))) for i in range(packing.ISLANDS)]
        for e in range(packing.EPOCHS):
            pools = [packing.evolve(p, s, 100, np.random.default_rng((k, e, i))) for i, p in enumerate(pools)]
            elites = [p[0] for p in pools]
            pools = [[*p[:-1], elites[i - 1]] for i, p in enumerate(pools)]
        assert min(len(np.bincount(x)) for x in elites) == fewest_bins(sizes, 100)


def test_evolution_improves_on_best_fit():
    """Sizes that descending best fit packs badly."""
    rng = np.random.default_rng(7)
    sizes = rng.integers(700, 2200, 2000).astype(np.int32)
    plain = len(np.bincount(packing.best_fit(sizes, np.argsort(-sizes, kind="stable"), 4096)))
    pool = packing.populate(sizes, 4096, rng)
    after = packing.evolve(pool, sizes, 4096, rng, packing.EPOCHS * packing.GENERATIONS)[0]
    fill = np.bincount(after, sizes)
    assert fill.max() <= 4096
    assert len(fill) < plain
    child = packing.crossover(pool[0], pool[1], sizes, 4096, rng)
    assert np.bincount(child, sizes).max() <= 4096
    assert np.bincount(child).min() > 0


# --- 5


def brute_suffix(rows, n=50):
    least = {}
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - n + 1):
            s = b[k : k + n]
            if i is not None and (s not in least or i < least[s]):
                least[s] = i
    out = []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if i is not None and least[b[k : k + n]] < i:
                gone[k : k + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 2])
@pytest.mark.parametrize("which", ["documents", "hostile", "none_at_all"])
def test_suffix_dedup(which, hot, request, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    df = request.getfixturevalue(which)
    got = [(str(r["id"]), r["n_bytes"], r["n_removed"], r["n_spans"], suffix_dedup.sha256(r["kept"])) for r in suffix_dedup.dedup(df).collect()]
    assert sorted(got) == brute_suffix(rows_of(df))


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup_of_a_line_repeated_inside_a_document(spark, hot, monkeypatch):
    """The line's middle stands in a smaller document, its whole neighbourhood twice or more in its first one alone."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(12)
    word = lambda n: "".join(chr(97 + k) for k in rng.integers(26, size=n))
    p, a, z = word(64), word(40), word(40)
    line = a + p + z
    rows = [(1, word(70) + p + word(70)), (2, word(30) + line + word(90) + line + word(30)), (3, line + word(60)), (2, word(11) + line * 3)]
    got = [(str(r["id"]), r["n_bytes"], r["n_removed"], r["n_spans"], suffix_dedup.sha256(r["kept"])) for r in suffix_dedup.dedup(spark.createDataFrame(rows + rows[1:2], "doc_id long, text string")).collect()]
    assert sorted(got) == brute_suffix(rows + rows[1:2])


def test_maximal_repeats_list_all_occurrences():
    rng = np.random.default_rng(3)
    base = bytes(rng.integers(97, 99, 60).astype(np.uint8))
    texts = [b"xx" + base + b"y", base[:30] + b"q" + base, bytes(rng.integers(97, 99, 90).astype(np.uint8)), base, base[5:45] * 2]
    least = 8
    want = defaultdict(set)
    for n in range(least, 70):
        at = defaultdict(set)
        for i, t in enumerate(texts):
            for k in range(len(t) - n + 1):
                at[t[k : k + n]].add((i, k))
        for where in at.values():
            if len(where) < 2:
                continue
            before = {texts[i][k - 1] if k else (i, k, "start") for i, k in where}
            after = {texts[i][k + n] if k + n < len(texts[i]) else (i, k, "end") for i, k in where}
            if len(before) > 1 and len(after) > 1:
                want[n].add(frozenset(where))
    got = defaultdict(set)
    for n, own, place in suffix_dedup.maximal_repeats(texts, least):
        got[n].add(frozenset(zip(own.tolist(), place.tolist(), strict=True)))
    assert got == want


# --- 6


def brute_lines(rows, min_docs, max_gone):
    """Verdicts, and the texts of kept rows without the removed lines."""
    norm = lambda line: re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()
    held = defaultdict(set)
    for i, t, s in rows:
        for line in t.split("\n"):
            if WORD.search(line):
                held[s, norm(line)].add((i, t))
    out, texts = [], []
    for i, t, s in rows:
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        bad = lambda x: WORD.search(x) and len(held[s, norm(x)]) > min_docs  # noqa: E731, B023
        gone = sum(len(WORD.findall(x)) for x in lines if bad(x))
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        kept = not failed and gone <= len(w) * max_gone
        out.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed, gone, kept))
        if kept:
            texts.append((str(i), "\n".join(x for x in t.split("\n") if not bad(x))))
    return sorted(out), sorted(texts)


def line_cases(spark):
    """A host with footers in every document, one of few documents, copies under several ids, and repeated rows."""
    body = lambda k, n: " ".join(f"b{k}word{j}" for j in range(n))
    rows = [(k, f"{body(k, 60)}\n  Read MORE   of our pages here \n{body(k + 500, 9)}", "big", 1) for k in range(12)]
    rows += [(100 + k, f"{body(100 + k, 45)}\nRead more of our pages here\n" * (1 + k % 2) + "all our rights are reserved by us today and in all times to come", "big", 1) for k in range(8)]
    rows += [(200 + k, f"{body(200 + k, 80)}\nRead more of our pages here", "small", 1) for k in range(5)]
    rows += [(300 + k, body(300, 70), "big", 1) for k in range(7)] + [(400, body(400, 70), "big", 1)] * 9 + [(None, body(401, 70), None, None)] * 9
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")


@pytest.mark.parametrize("which", ["documents", "hostile", "none_at_all", "lines"])
def test_line_quality(spark, which, request):
    df = line_cases(spark) if which == "lines" else request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"] or "", r["source"] or "") for r in df.collect()]
    for limits in ((1, 0.0), (line_quality.MIN_DOCS, line_quality.MAX_GONE)):
        want, texts = brute_lines(rows, *limits)
        assert sorted((str(r["id"]), *r[1:]) for r in line_quality.judge(df, min_docs=limits[0], max_gone=limits[1]).collect()) == want
        got = line_quality.clean(df, min_docs=limits[0], max_gone=limits[1])
        assert got.columns == df.columns
        assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == texts
    if which == "lines":
        assert sum(not w[6] and not w[8] for w in want) >= 11  # the rule rejects what the base lets through
        assert any(w[7] and w[8] for w in want)


# --- 8


def test_toxicity_on_held_out_rows(spark):
    """Fitted and judged at a size where insults are seen often enough."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op8_fm_toxicity(spark, sf).collect()
    assert len(got) == 1000
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    test = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in test) / len(test) > 0.9


def test_machine_learns_a_pair_that_single_terms_cannot():
    """Label 1 only where exactly one of two terms is there."""
    row, term, y = [], [], []
    for i in range(400):
        own = [i % 2, 2 * 0 + (i // 2) % 2]
        row += [i] * sum(own)
        term += [k for k, on in enumerate(own) if on]
        y.append(own[0] ^ own[1])
    m = toxicity.Machine(2)
    m.fit(np.array(row), np.array(term), np.array(y, float), np.ones(400), rounds=600)
    p = 1 / (1 + np.exp(-m.raw(np.array(row), np.array(term), 400)))
    assert (np.round(p) == y).all()


def test_toxicity_hostile(spark, hostile, none_at_all):
    labels = spark.createDataFrame([(1, 1), (None, 1), (4, None), (7, 0), (7, 0)], "doc_id long, toxic int")
    machine, chosen = toxicity.fit(hostile, labels)
    got = toxicity.score(hostile, machine, chosen)
    assert got.columns == [c for c in hostile.columns if c != "score"] + ["score"]
    assert got.count() == hostile.count()
    assert got.where("text IS NULL").count() == 1
    machine, chosen = toxicity.fit(none_at_all, labels.where("false"))
    assert [r.score for r in toxicity.score(hostile, machine, chosen).select("score").distinct().collect()] != []
    assert toxicity.score(none_at_all, machine, chosen).count() == 0


# --- 9


def brute_chunks(b):
    h, last, ends = 0, 0, []
    for k, x in enumerate(b):
        h = ((h << 1) + int(chunk_dedup.GEAR[x])) & 0xFFFFFFFF
        if h >> (32 - chunk_dedup.CUT_BITS) == 0 and k + 1 - last >= chunk_dedup.SHORTEST:
            ends.append(k + 1)
            last = k + 1
    if last < len(b):
        if ends and len(b) - last < chunk_dedup.SHORTEST:
            ends.pop()
        ends.append(len(b))
    return ends


def brute_chunk_dedup(rows):
    """Of each row what ``dedup`` returns: its chunks against the first of each digest by (id, position, hash of the text)."""
    every = []
    for i, t in {(i, t) for i, t in rows if i is not None}:
        ends = brute_chunks(t.encode())
        h = np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64).item()
        every.extend(((i, a, h), (i, t), t.encode()[a:z]) for a, z in zip([0, *ends], ends, strict=False))
    first, gone = {}, defaultdict(list)
    for place, own, s in sorted(every):
        if first.setdefault(s, place) != place:
            gone[own].append((place[1], place[1] + len(s), first[s][0]))
    want = []
    for i, t in rows:
        b, spans = t.encode(), sorted(gone[i, t])
        kept, at = b"", 0
        for a, z, _ in spans:
            kept, at = kept + b[at:a], z
        runs = sum(1 for k, s in enumerate(spans) if k == 0 or spans[k - 1][1] != s[0])
        want.append((str(i), len(b), sum(z - a for a, z, _ in spans), runs, kept + b[at:], sorted({f for _, _, f in spans})))
    return sorted(want)


def chunked(df):
    return sorted((str(r["id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["first_ids"] or []) for r in chunk_dedup.dedup(df).collect())


@pytest.mark.parametrize("which", ["documents", "hostile", "none_at_all"])
def test_chunk_dedup(which, request):
    df = request.getfixturevalue(which)
    assert chunked(df) == brute_chunk_dedup(rows_of(df))


def test_chunk_dedup_of_different_texts_under_one_id(spark):
    rng = np.random.default_rng(31)
    word = lambda n: "".join(chr(97 + k) for k in rng.integers(26, size=n))
    a, b, c = word(419), word(419), word(300)
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b + c), (3, c + word(50)), (None, c), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = chunked(df)
    assert got == brute_chunk_dedup([(i, t or "") for i, t in rows])
    assert [r[2] for r in got if r[0] == "2"].count(0) == 2  # b is new at id 2, and both its rows stay whole
    names = chunk_dedup.dedup(df.selectExpr("cast(doc_id AS string) AS doc_id", "text")).collect()
    assert sorted(r["n_removed"] for r in names) == sorted(r[2] for r in got)


def test_chunks_resist_shifts():
    rng = np.random.default_rng(4)
    b = rng.integers(97, 123, 20_000).astype(np.uint8)
    moved = np.concatenate([b[:5000], rng.integers(97, 123, 7).astype(np.uint8), b[5000:]])
    cut = lambda x: {x[a:z].tobytes() for a, z in zip([0, *chunk_dedup.chunk_ends(x)], chunk_dedup.chunk_ends(x), strict=False)}
    assert len(cut(b) - cut(moved)) <= 6


# --- 10


def brute_matches(docs, items, least=0.8):
    """Every window of every document against every item: no shingle need be shared, no fingerprint, no rule by length."""
    word = re.compile(rb"[0-9a-z\x80-\xff]+")
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    items = [(j, v, bag(v)) for j, v in ((j, word.findall(lower(u).encode())) for j, u in items) if v]
    out = []
    for i, t in docs:
        w = word.findall(lower(t).encode())
        for j, v, b in items:
            best = -1.0, 0
            for k in range(max(1, len(w) - len(v) + 1)) if w else ():
                a = bag(w[k : k + len(v)])
                same = sum(min(c, b[g]) for g, c in a.items() if g in b)
                best = max(best, (same / (a.total() + b.total() - same), -k))
            if best[0] >= least:
                out.append((str(i), j, round(best[0], 9), -best[1]))
    return sorted(out)


def test_decontamination(spark, documents, hostile):
    """All windows of the documents that are not too long, and copies of items with edits of every strength."""
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").orderBy("item_id").limit(30)
    bench = [(r.item_id, r.text) for r in items.collect()]
    edited = []
    rng = np.random.default_rng(6)
    for n in range(90):
        w = bench[n % 30][1].split()
        for _ in range(n % 3):
            w[int(rng.integers(len(w)))] = f"edit{n}"
        if n % 5 == 4:
            w = w[: len(w) - n % 4]
        edited.append((10_000 + n, "Before it! " * (n % 4) + " ".join(w).upper() + " and after." * (n % 2)))
    docs = documents.where("n_chars < 1500").limit(40).select("doc_id", "text").unionAll(hostile.where("doc_id IS NULL OR doc_id <> 4").selectExpr("doc_id + 500000", "text")).unionAll(spark.createDataFrame(edited, "doc_id long, text string"))
    extra = [(900, None), (901, ""), (902, "plain words here and there"), (903, "Plain, words"), (904, "after"), (905, "passage word"), (905, "passage word"), (906, "words here and there"), (907, "and after plain")]
    items = items.unionAll(spark.createDataFrame(extra, "item_id long, text string"))
    want = brute_matches(rows_of(docs), sorted({(r.item_id, r.text or "") for r in items.collect()}))
    got = sorted((str(r["id"]), r["item_id"], round(r["similarity"], 9), r["first_word"]) for r in decontaminate.matches(docs, items).collect())
    assert set(got) <= set(want)
    assert len(got) == len(want)  # the radius may lose one in 2,000
    assert sum(j < 900 for _, j, *_ in want) >= 30
    assert {j for _, j, *_ in want} >= {902, 903, 904, 905, 906}
    left = decontaminate.clean(docs, items)
    hit = {i for i, *_ in want}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in rows_of(docs) if str(i) not in hit)
    none = items.where("false")
    assert decontaminate.matches(docs, none).count() == 0
    assert decontaminate.clean(docs, none).count() == docs.count()
    assert decontaminate.matches(docs.where("false"), items).count() == 0


def test_blocks_of_items(spark, documents, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(str, decontaminate.matches(documents, items).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS", 30)
    assert sorted(map(str, decontaminate.matches(documents, items).collect())) == whole
    assert whole


def test_documents_shorter_than_the_item(spark):
    w = [f"w{k}" for k in range(59)]
    docs = spark.createDataFrame([(1, " ".join(w[:55])), (2, " ".join(w[3:])), (3, " ".join(w[:40])), (4, "x " * 70 + " ".join(w))], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(w))], "item_id long, text string")
    got = sorted((r["id"], r["item_id"], round(r["similarity"], 9), r["first_word"]) for r in decontaminate.matches(docs, items).collect())
    assert got == [(1, 9, round(51 / 55, 9), 0), (2, 9, round(52 / 55, 9), 0), (4, 9, 1.0, 70)]
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [3]


def test_multi_index_finds_every_fingerprint_within_the_radius_and_lists_few_others():
    rng = np.random.default_rng(8)
    for words in (20, 54):
        texts = [" ".join(f"w{rng.integers(50)}" for _ in range(words)) for _ in range(120)]
        index = decontaminate.Index(list(range(120)), texts)
        own, known, _, far = index.by_size[words]
        probe = rng.integers(0, 1 << 16, (4000, 4)).astype(np.uint16)
        probe[:200] = known[rng.integers(0, 120, 200)] ^ (rng.random((200, 4)) < 0.5) * rng.integers(0, 1 << 16, (200, 4)).astype(np.uint16)
        d = np.bitwise_count(probe[:, None, :] ^ known[None]).sum(axis=2)
        want = {(int(w), int(own[i])) for w, i in zip(*np.nonzero(d <= far), strict=True)}
        assert set(zip(*(x.tolist() for x in index.lookup(words, probe)), strict=True)) == want
        share = len(index.listed(words, probe[200:])[0]) / (3800 * 120)
        assert share < (0.2 if words > 30 else 0.75)
        w, i = index.near(words, probe)
        assert {(int(a), int(own[b])) for a, b in zip(*np.nonzero(d <= index.wide[words]), strict=True)} == set(zip(w.tolist(), i.tolist(), strict=True))


def test_radius_keeps_pairs_at_the_threshold():
    """Windows of real words with edits that leave a similarity of 0.8 or just above."""
    rng = np.random.default_rng(12)
    for k in (12, 20, 40, 55):
        lost = 0
        for _ in range(300):
            a = rng.integers(0, 1 << 63, k).astype(np.uint64)
            b = a.copy()
            common = int(np.ceil(0.8 * 2 * k / 1.8 - 1e-9))
            b[rng.permutation(k)[: k - common]] = rng.integers(0, 1 << 63, k - common).astype(np.uint64)
            x, y = (decontaminate.simhash(v).sum(axis=0) > 0 for v in (a, b))
            lost += (x != y).sum() > decontaminate.radius(k)
        assert lost <= 2


@pytest.mark.parametrize(("words", "run"), [(150, 12), (170, 12), (220, 20), (60, 9), (24, 7)])
def test_drills_and_refrains_are_found(words, run):
    """Items with one word many times over, and windows with one, at similarities from 0.8 on."""
    rng = np.random.default_rng(words + run)
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 1 << 40, n)]
    items, texts, similar = [], [], []
    for n in range(200):
        a = fresh(words)
        b, at = list(a), int(rng.integers(5, words - run - 5))
        which = a if n % 2 else b
        which[at : at + run] = [which[at]] * run
        fits = lambda w: (lambda x, y: (x & y).total() / (x | y).total())(bag(a), bag(w))  # noqa: B023, E731
        if fits(b) < 0.8:
            b = list(a)
        while fits(c := [*b[:-1][1:], *fresh(2)]) >= 0.8:  # noqa: B023
            b = c
        items.append(" ".join(a))
        texts.append(" ".join(b))
        similar.append(fits(b))
    assert 0.8 <= min(similar) and np.median(similar) < 0.9
    index = decontaminate.Index(list(range(200)), items)
    found = {(r, i): s for r, i, s, _ in index.scan(pa.array(texts, pa.large_string()))}
    assert sum(found.get((k, k), 0) == pytest.approx(similar[k]) for k in range(200)) >= 199


# --- words


def test_words_and_hashes_of_batches():
    texts = ["One two  TWO", "", "two", None, "é\tone\n", " x "]
    b = pa.RecordBatch.from_pydict({"t": pa.array(texts)})
    for size in (1, 8, 1 << 20):
        got = []
        for part in text.pieces(iter([b]), "t", size):
            data, offsets = text.raw(part.column("t"))
            s, e, row = text.spans(text.LOWER[data], offsets)
            h = text.hashes(text.LOWER[data], s, e)
            got.extend([bytes(text.LOWER[data][a:z]) for a, z in zip(s, e, strict=True)])
            for k in range(part.num_rows):
                assert (row == k).sum() == len(WORD.findall(part.column("t")[k].as_py()))
            assert len(set(h.tolist())) == len({bytes(text.LOWER[data][a:z]) for a, z in zip(s, e, strict=True)})
        assert got == [w.encode() for t in texts if t for w in WORD.findall(lower(t))]
