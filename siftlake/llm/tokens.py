"""Token ids of whole texts with a public tokenizer, through a bounded cache of the parts that texts split into.

The tokenizer drops white space and never joins across its splits, so the ids of a text are the ids of its parts in order.
Text of printable ASCII, Latin-1 letters and white space is lower-cased and split here as the tokenizer's own normalizer
and splitter would, and only parts not seen before go through the library's byte-pair model, without the tokenizer around it. Words with any other
character go through the whole tokenizer. ``tests/llm`` holds this against the library on whole texts.
"""

from __future__ import annotations

import os
import re
from itertools import pairwise

import numpy as np

#: Parts a worker keeps, the longest part that is kept, and the characters taken at a time.
CACHED_PARTS, CACHED_CHARS, STRETCH = 600_000, 40, 1 << 20

#: What the fast path takes, and how such text, lower-cased, splits. Fixed by the tokenizer file.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ \t\n\v\f\r]*")
_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-zß-öø-ÿ0-9 \t\n\v\f\r]+")
_SPACE = re.compile("[ \t\n\v\f\r]")

#: The letters that stand for a character's bytes in a byte-level model; printable ASCII stands for itself.
_BYTE = dict(zip((b for b in range(256) if not 33 <= b <= 126 and not 161 <= b <= 172 and b < 174), range(256, 512)))
_BYTES = {c: "".join(chr(_BYTE.get(b, b)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}

_encoders: dict[str, Encoder] = {}


class Encoder:
    """``encode`` gives each text's ids as a numpy array; ``width`` is the type that holds any id."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.pairs = self.model.model
        self.width = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        # the fast path follows one splitter; a file with another takes the whole tokenizer for every text
        probe = ["It's", "a_-b", "x12y", "don't;'re", "Ünï-cö'ß x\n\ty  z"]
        self.splits = all(self.model.encode(w, add_special_tokens=False).ids == [i for p in self._of_parts(_PARTS.findall(w.lower())) for i in np.frombuffer(p, self.width)] for w in probe)
        self.parts: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(g.ids, self.width).tobytes() for g in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        ids: list[int] = []
        ends = [0]
        for p in parts:
            ids += [t.id for t in self.pairs.tokenize(p if p.isascii() else p.translate(_BYTES))]
            ends.append(len(ids))
        data, wide = np.array(ids, self.width).tobytes(), self.width.itemsize
        return [data[a * wide : z * wide] for a, z in pairwise(ends)]

    def _stretches(self, t: str) -> list[tuple[bool, str]]:
        """(plain, stretch): the text in stretches of bounded length, cut at white space; odd words are stretches of their own."""
        if self.splits and len(t) <= STRETCH and "<|" not in t and _PLAIN.fullmatch(t):
            return [(True, t)]
        if not self.splits:
            return [(False, t)]
        out, at = [], 0
        while at < len(t):
            m = _SPACE.search(t, at + STRETCH)
            end = m.start() if m else len(t)
            part = t[at:end]
            if "<|" not in part and _PLAIN.fullmatch(part):
                out.append((True, part))
            else:
                out.extend(("<|" not in w and _PLAIN.fullmatch(w) is not None, w) for w in _SPACE.split(part) if w)
            at = end
        return out

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        """Ids of each text, and ``end`` after them."""
        last = np.array([end], self.width).tobytes()
        found = [[(plain, _PARTS.findall(s.lower()) if plain else s) for plain, s in self._stretches(t)] for t in texts]
        seen: set[str] = set()
        whole: list[str] = []
        for f in found:
            for plain, own in f:
                if plain:
                    seen.update(own)
                else:
                    whole.append(own)
        new = [p for p in seen if p not in self.parts]
        fresh = dict(zip(new, self._of_parts(new), strict=True))
        self.parts.update(fresh)
        others, get = iter(self._ids(whole)), self.parts.__getitem__
        out = []
        for f in found:
            joined: list[bytes] = []
            for plain, own in f:
                if plain:
                    joined.extend(map(get, own))
                else:
                    joined.append(next(others))
            joined.append(last)
            out.append(np.frombuffer(b"".join(joined), self.width))
        if len(self.parts) > CACHED_PARTS:
            self.parts = fresh
        for p in new:
            if len(p) > CACHED_CHARS:
                del self.parts[p]
        return out


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
