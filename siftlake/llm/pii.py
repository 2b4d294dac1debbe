"""Personal data in whole texts: exact patterns, and a linear-chain conditional random field for forms they miss.

The patterns give the base spans, leftmost and non-overlapping for each kind. The field labels runs of words that hold a
digit or an at sign (no other word can be a number, an address or a mail name here); the two words before and the word
after a run are features only. It is trained on the labelled rows of ``labelled_table`` by exact gradients from the
forward-backward sums, and decoded by Viterbi over numpy batches of runs of equal length. Its spans are added where they
overlap no base span.

Nulls are empty texts; spans count code points; long texts and long runs are handled whole, in linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm import text

KINDS = ("email", "ip", "card", "phone")
_SPACE = " \t\n\v\f\r"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# possessive runs of digits: where a run fails no later start inside it can match, so long runs stay linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        n = n * 2 if k % 2 else n
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(t: str) -> list[tuple[int, int]]:
    """The leftmost match at each at sign begins where its run of local characters does, or at the end of the match before."""
    out, done, at = [], 0, t.find("@")
    while at >= 0:
        first = at
        while first > done and t[first - 1] in _LOCAL:
            first -= 1
        m = _DOMAIN.match(t, at + 1) if first < at else None
        if m:
            done = m.end()
            out.append((first, done))
        at = t.find("@", max(at + 1, done))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all pattern matches, by start and then kind."""
    out = [(a, b, 0) for a, b in _emails(t)] if "@" in t else []
    if _HINT.search(t):
        for m in _IP.finditer(t):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in t:
            out.extend((m.start(), m.end(), 3) for m in _PHONE.finditer(t) if 9 <= len(_digits(m[0])) <= 15)
    return sorted(out, key=lambda s: (s[0], s[2]))


_HINT = re.compile("[0-9]")
_MARK = re.compile("[0-9@]")
_WORD_END = re.compile(r"[^\x20\x09-\x0D]*")

# --- the conditional random field -------------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def word_features(word: str) -> tuple[str, ...]:
    """What the whole word looks like: its collapsed shape, counts of digits, and checks that need the digits themselves."""
    return _kept_features(word) if len(word) <= 64 else _features(word)  # long words are not worth their memory


def _features(word: str) -> tuple[str, ...]:
    core = word.strip(".,;:!?\"'*&%$#|<>")
    shape = re.sub(r"[0-9]", "d", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", core)))  # digits last: their mark is a letter
    shape = "".join(c if c in "aAd@.+-()/:,$=_#" else "x" for c in shape)
    runs = re.sub(r"(.)\1+", r"\1", shape)
    exact = re.sub(r"(.)\1*", lambda m: m[1] + str(min(len(m[0]), 17)), shape) if len(shape) <= 24 else "long"
    d = _digits(core)
    n = min(len(d), 20)
    out = ["w:" + runs, "e:" + exact, f"n:{n}", "lead:" + core[:1] if core[:1] in "+($@#\"" else "lead:"]
    if 12 <= n <= 19:
        out.append(f"luhn:{luhn(d)}")
    if m := re.fullmatch(r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})(:[0-9]+)?", core):
        out.append(f"quad:{all(int(p) <= 255 for p in m[1].split('.'))}:{bool(m[2])}")
    if "@" in core:
        out.append(f"mail:{bool(re.fullmatch(r'[^@]+@[^@.]+(.[^@.]+)+', core))}")
    return tuple(out)


_kept_features = lru_cache(maxsize=100_000)(_features)

_CUES = frozenset("phone tel call fax mobile telephone telefon ip host server address mail email card visa order invoice version id number ref page token".split())


def token_features(run: list[str], k: int, before: tuple[str, str], after: str) -> list[str]:
    out = list(word_features(run[k]))
    previous = run[k - 1] if k else None
    nxt = run[k + 1] if k + 1 < len(run) else None
    out.append("p:" + (word_features(previous)[1] if previous else "^"))
    out.append("f:" + (word_features(nxt)[1] if nxt else "$"))
    for w in before:
        cue = w.lower().strip(".,:;=\"'()")
        if cue in _CUES:
            out.append("cue:" + cue)
    return out


def _draw(rng: np.random.Generator, pattern: str) -> str:
    return "".join(str(rng.integers(10)) if c == "d" else "abcdefghijklmnoprstuvwz"[rng.integers(23)] if c == "l" else c for c in pattern)


def _card(rng: np.random.Generator, ok: bool) -> str:
    d = _draw(rng, "4dddddddddddddd")
    check = next(c for c in "0123456789" if luhn(d + c))
    return d + (check if ok else str((int(check) + 1 + rng.integers(8)) % 10))


def labelled_table(n: int = 1440, seed: int = 5) -> list[tuple[tuple[str, str], list[str], str, list[str]]]:
    """Labelled rows: (two words before, run of words, word after, labels), drawn from forms with and without personal data."""
    rng = np.random.default_rng(seed)
    quad = lambda top: ".".join(str(rng.integers(1, top)) for _ in range(4))
    rows = []
    for i in range(n):
        cue = lambda *words: words[rng.integers(len(words))] if rng.random() < 0.5 else _draw(rng, "llll")
        kind = i % 24
        if kind == 0:
            run, labels, w = [_draw(rng, "+d"), _draw(rng, "(ddd)"), _draw(rng, "ddd-dddd")], ["B-phone", "I-phone", "I-phone"], cue("phone", "call", "tel")
        elif kind == 1:
            run, labels, w = [_draw(rng, "(ddd)"), _draw(rng, "ddd-dddd")], ["B-phone", "I-phone"], cue("phone", "tel", "call")
        elif kind == 2:
            run, labels, w = [_draw(rng, ("ddd-ddd-dddd", "ddd.ddd.dddd", "(ddd)ddd-dddd")[rng.integers(3)])], ["B-phone"], cue("phone", "fax", "mobile")
        elif kind == 3:
            run, labels, w = [_draw(rng, "lllll.dd@llll.llll.lll")], ["B-email"], cue("mail", "email")
        elif kind == 4:
            run, labels, w = [_draw(rng, ("lll@lllll.lll", "llllld@llll-lll.ll", "l.llll@lllld.lll")[rng.integers(3)])], ["B-email"], cue("mail", "email")
        elif kind == 5:
            run, labels, w = [quad(256)], ["B-ip"], cue("ip", "host", "server")
        elif kind == 6:
            run, labels, w = [f"{quad(256)}:{rng.integers(80, 9000)}"], ["B-ip"], cue("ip", "host", "server")
        elif kind == 7:
            run, labels, w = [_card(rng, True)], ["B-card"], cue("card", "visa")
        elif kind == 8:
            d = _card(rng, True)
            run, labels, w = [d[:4], d[4:8], d[8:12], d[12:]], ["B-card", "I-card", "I-card", "I-card"], cue("card", "visa")
        elif kind == 9:
            d = _card(rng, True)
            run, labels, w = [".".join((d[:4], d[4:8], d[8:12], d[12:]))], ["B-card"], cue("card", "visa")
        elif kind == 10:
            run, labels, w = [_card(rng, False)], ["O"], cue("order", "invoice", "ref", "number")
        elif kind == 11:
            run, labels, w = ['"' + "".join("0123456789abcdef"[rng.integers(16)] for _ in range(40)) + '"'], ["O"], cue("token", "id")
        elif kind == 12:
            run, labels, w = [_draw(rng, ("d.d", "d.d.d", "d.dd", "d")[rng.integers(4)])], ["O"], cue("version")
        elif kind == 13:
            run, labels, w = [_draw(rng, ("dddd-dd-dd", "dd:dd", "dd/dd/dddd", "dd.dd.dddd", "dd:dd:dd")[rng.integers(5)])], ["O"], cue("page")
        elif kind == 14:
            run, labels, w = [_draw(rng, ("dddd", "d,ddd", "dd%", "$dd.dd", "ddddd", "ddd", "dd", "dddddd", "ddddddddd", "dddddddddddd")[rng.integers(10)])], ["O"], cue("page", "number", "order")
        elif kind == 15:
            run, labels, w = [f"{rng.integers(256, 999)}.{quad(999)}"[:15]], ["O"], cue("version")
        elif kind == 16:
            run = [_draw(rng, ("dddd", "dd", "ddd")[rng.integers(3)]) for _ in range(rng.integers(2, 6))]
            labels, w = ["O"] * len(run), cue("page", "number")
        elif kind == 17:
            run, labels, w = [_card(rng, True), _card(rng, False)][:: 1 if rng.random() < 0.5 else -1], [], cue("order")
            labels = ["B-card" if luhn(x) else "O" for x in run]
        elif kind == 18:
            run, labels, w = [_draw(rng, ("@lllll", "lll@lll", "@", "@lll_dd")[rng.integers(4)])], ["O"], cue("ref")
        elif kind == 19:  # phone-like groups that a page or an order number stands before
            run, labels, w = [_draw(rng, ("ddd-ddd-dddd", "ddd.ddd.dddd", "ddd-dddd")[rng.integers(3)])], ["O"], ("page", "order", "invoice", "ref", "version")[rng.integers(5)]
        elif kind == 20:  # versions of four parts, with and without a build
            run, labels, w = [f"v{quad(256)}" + (f":{rng.integers(80, 9000)}" if rng.random() < 0.5 else "")], ["O"], cue("version", "token")
        elif kind == 21:
            run, labels, w = [f"{quad(256)}-{_draw(rng, ('lld', 'dd', 'llll')[rng.integers(3)])}"], ["O"], cue("version")
        elif kind == 22:
            run, labels, w = [_draw(rng, ("ddd-ddd-dddd", "(ddd)ddd-dddd", "+dd.ddd.ddd.dddd")[rng.integers(3)])], ["B-phone"], ("phone", "call", "tel", "fax")[rng.integers(4)]
        else:
            run, labels, w = [_draw(rng, ("lld", "LLdd".lower(), "ld-ll", "lll_dd", "ddlll", "#dd", "ddd-dddd")[rng.integers(7)])], ["O"], cue("id", "ref")
        tail = ".,;"[rng.integers(3)] if rng.random() < 0.2 else ""
        rows.append(((_draw(rng, "lllll"), w), [*run[:-1], run[-1] + tail], _draw(rng, "lll"), labels))
    return rows


class Field:
    """Weights of a linear-chain conditional random field over ``LABELS``; ``emit`` holds one row for each feature known."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray, first: np.ndarray) -> None:
        self.index, self.emit, self.move, self.first = index, emit, move, first

    def scores(self, features: list[list[str]]) -> np.ndarray:
        known = [[self.index[f] for f in fs if f in self.index] for fs in features]
        counts = np.fromiter(map(len, known), np.int64, len(known))
        flat = np.fromiter((i for k in known for i in k), np.int64, int(counts.sum()))
        out = np.zeros((len(known), len(LABELS)))
        np.add.at(out, np.repeat(np.arange(len(known)), counts), self.emit[flat])
        return out

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Viterbi: the best labels of a batch (runs, length, labels) of runs of one length."""
        n, length, _ = scores.shape
        best, back = self.first + scores[:, 0], np.zeros((n, length, len(LABELS)), np.int8)
        for t in range(1, length):
            step = best[:, :, None] + self.move
            back[:, t] = step.argmax(axis=1)
            best = step.max(axis=1) + scores[:, t]
        path = np.zeros((n, length), np.int8)
        path[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            path[:, t - 1] = back[np.arange(n), t, path[:, t]]
        return path


def train(rows: list[tuple[tuple[str, str], list[str], str, list[str]]], rounds: int = 120, rate: float = 0.25, decay: float = 1e-3) -> Field:
    """Full-batch gradient ascent of the mean log-likelihood with per-weight steps (Adagrad)."""
    features = [[token_features(run, k, before, after) for k in range(len(run))] for before, run, after, _ in rows]
    index = {f: i for i, f in enumerate(sorted({f for r in features for fs in r for f in fs}))}
    size, n = len(LABELS), len(rows)
    groups: dict[int, list[int]] = defaultdict(list)
    for i, (_, run, _, _) in enumerate(rows):
        groups[len(run)].append(i)
    data = []
    for length, at in sorted(groups.items()):
        design = np.zeros((len(at), length, len(index)))
        truth = np.array([[LABELS.index(x) for x in rows[i][3]] for i in at])
        for j, i in enumerate(at):
            for k, fs in enumerate(features[i]):
                design[j, k, [index[f] for f in fs]] = 1
        data.append((length, design.reshape(-1, len(index)), np.eye(size)[truth]))
    model = Field(index, np.zeros((len(index), size)), np.zeros((size, size)), np.zeros(size))
    weights = [model.emit, model.move, model.first]
    sums = [np.full_like(w, 1e-6) for w in weights]
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    for _ in range(rounds):
        grads = [-decay * w for w in weights]
        for length, design, truth in data:
            s = (design @ model.emit).reshape(-1, length, size)
            ahead, behind = np.zeros_like(s), np.zeros_like(s)
            ahead[:, 0] = model.first + s[:, 0]
            for t in range(1, length):
                ahead[:, t] = lse(ahead[:, t - 1, :, None] + model.move, 1) + s[:, t]
            for t in range(length - 2, -1, -1):
                behind[:, t] = lse(model.move + (s[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            z = lse(ahead[:, -1], 1)
            rest = truth - np.exp(ahead + behind - z[:, None, None])
            grads[0] += design.T @ rest.reshape(-1, size) / n
            grads[2] += rest[:, 0].sum(axis=0) / n
            for t in range(1, length):
                pair = np.exp(ahead[:, t - 1, :, None] + model.move + (s[:, t] + behind[:, t])[:, None, :] - z[:, None, None])
                grads[1] += (np.einsum("na,nb->ab", truth[:, t - 1], truth[:, t]) - pair.sum(axis=0)) / n
        for w, g, q in zip(weights, grads, sums, strict=True):
            q += g * g
            w += rate * g / np.sqrt(q)
    return model


def _runs(t: str) -> list[tuple[list[tuple[int, int]], tuple[str, str], str]]:
    """Maximal runs of neighbouring words that hold a digit or an at sign: their places, the words before and after."""
    runs: list[list[tuple[int, int]]] = []
    m = _MARK.search(t)
    while m:
        first = m.start()
        while first and t[first - 1] not in _SPACE:
            first -= 1
        last = _WORD_END.match(t, m.start()).end()
        if runs and not t[runs[-1][-1][1] : first].strip(_SPACE):
            runs[-1].append((first, last))
        else:
            runs.append([(first, last)])
        m = _MARK.search(t, last)
    return [(r, _words_before(t, r[0][0]), _word_after(t, r[-1][1])) for r in runs]


def _words_before(t: str, at: int) -> tuple[str, str]:
    """The two whole words before a place, empty where there are none: a wider look back is taken while a third may follow."""
    width = 60
    while len(words := t[max(0, at - width) : at].split()) < 3 and width < at:
        width *= 2
    return tuple((["", ""] + words)[-2:])


def _word_after(t: str, at: int) -> str:
    width = 30
    while len(words := t[at : at + width].split()) < 2 and at + width < len(t):
        width *= 2
    return words[0] if words else ""


def field_spans(texts: list[str], model: Field) -> list[list[tuple[int, int, int]]]:
    """Spans the field finds in each text."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = [(i, *r) for i, t in enumerate(texts) for r in _runs(t)]
    by_length: dict[int, list[int]] = defaultdict(list)
    for j, (_, words, _, _) in enumerate(runs):
        by_length[len(words)].append(j)
    for length, at in by_length.items():
        step = max(1, 20_000 // length)
        for c in range(0, len(at), step):
            part = at[c : c + step]
            features = []
            for j in part:
                i, words, before, after = runs[j]
                own = [texts[i][a:b] for a, b in words]
                features.extend(token_features(own, k, before, after) for k in range(length))
            path = model.decode(model.scores(features).reshape(len(part), length, len(LABELS)))
            for j in np.flatnonzero(path.any(axis=1)):
                i, words, _, _ = runs[part[j]]
                open_ = None
                for (a, b), tag in zip(words, path[j].tolist(), strict=True):
                    kind, begins = (tag - 1) // 2, tag % 2 == 1
                    if tag and not begins and open_ and open_[2] == kind:
                        open_ = (open_[0], b, kind)
                        continue
                    if open_:
                        found[i].append(open_)
                    open_ = (a, b, kind) if tag else None
                if open_:
                    found[i].append(open_)
        # punctuation around a span is none of it
    for i, own in enumerate(found):
        t, trimmed = texts[i], []
        for a, b, k in own:
            while a < b and t[a] in "\"'*&%$#|<>,;":
                a += 1
            while b > a and t[b - 1] in ".,;:!?\"'*&%$#|<>":
                b -= 1
            if a < b:
                trimmed.append((a, b, k))
        found[i] = trimmed
    return found


def all_spans(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans, and those of ``more`` that overlap none of them."""
    if not base or not more:
        return sorted([*base, *more], key=lambda s: (s[0], s[2]))
    begins = np.array([a for a, _, _ in base])  # ascending
    reach = np.maximum.accumulate([b for _, b, _ in base])
    before = np.searchsorted(begins, [b for _, b, _ in more])  # base spans that begin before a span's end
    new = [s for s, n in zip(more, before.tolist(), strict=True) if not n or reach[n - 1] <= s[0]]
    return sorted([*base, *new], key=lambda s: (s[0], s[2]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(t: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union goes, named by the first."""
    out, done = [], 0
    for a, b, k in spans:
        if a >= done:
            out.append(t[done:a] + f"[{KINDS[k].upper()}]")
        done = max(done, b)
    return "".join(out) + t[done:]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 120) -> DataFrame:
    """(id, base, spans, redacted) for each row: kind:start:end lists, and the text without what was found.

    One pass without a shuffle. Null texts count as empty, ids may repeat or be null, other columns are not read.
    """
    model = train(labelled_table(), rounds)

    def run(batches):
        for b in text.pieces(batches, "text"):
            texts = b.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            spans = [all_spans(x, y) for x, y in zip(base, field_spans(texts, model), strict=True)]
            clean = [redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(map(written, base), pa.string()), pa.array(map(written, spans), pa.string()), pa.array(clean, pa.string())], ["id", "base", "spans", "redacted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return text.bounded(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, base string, spans string, redacted string")


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = None, rounds: int = 120) -> DataFrame:
    """``docs`` with every span found replaced in the text, and ``length_col``, where there is one, counted anew.

    All rows and columns stay; a null text stays null, and its length as it was.
    """
    model = train(labelled_table(), rounds)
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for whole in batches:
            done = 0
            for b in text.pieces(iter([whole]), text_col):
                part = whole.slice(done, b.num_rows)
                done += b.num_rows
                texts = b.column(at).to_pylist()
                spans = [all_spans(base_spans(t), y) for t, y in zip(texts, field_spans(texts, model), strict=True)]
                known = part.column(at).is_valid().to_pylist()
                clean = [redact(t, s) if ok else None for t, s, ok in zip(texts, spans, known, strict=True)]
                cols = list(part.columns)
                cols[at] = pa.array(clean, cols[at].type)
                if length_col in names:
                    k = names.index(length_col)
                    old = cols[k].to_pylist()
                    cols[k] = pa.array([len(c) if c is not None else o for c, o in zip(clean, old, strict=True)], cols[k].type)
                yield pa.RecordBatch.from_arrays(cols, names)

    return text.bounded(docs).mapInArrow(run, docs.schema)
