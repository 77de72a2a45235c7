"""Token ids of public tokenizers, encoded once per distinct unit of a text.

No pre-token of the two tokenizers used here spans a change from non-space to space, so a text's ids are the ids of its
units (a run of spaces and the word behind it), one after the other. Units repeat, so their ids are held in a bounded
table of two generations. Texts with characters on whose class the libraries differ, or with a special token's string,
are encoded whole.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

UNIT = re.compile(r"\s*\S+|\s+")
WHOLE = re.compile("[\\x1c-\\x1f\\x85\\u180e\\u200b\\u2028\\u2029\\ufeff]|<\\|")
#: Words of these letters and signs can be cut where letters end: the apostrophe, marks and other scripts are left out.
SIMPLE = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff!-&(-@\\[-`{-~]+")
PART = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[!-&(-@\\[-`{-~]+")
#: Entries in one generation of a worker's table.
HELD = 300_000


class Held:
    """Two generations of a table; the older goes when the younger is full, and what was used since has moved up."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], most: int = HELD) -> None:
        self.make, self.most = make, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def fill(self, units: Iterable[str]) -> None:
        """After this, all of these units are in the younger table."""
        young = self.young
        if new := set(units).difference(young):
            if len(young) + len(new) > self.most:
                self.old, self.young = young, (young := {})
                new = set(units)
            old, unknown = self.old, []
            for u in new:
                if (v := old.get(u)) is None:
                    unknown.append(u)
                else:
                    young[u] = v
            if unknown:
                young.update(zip(unknown, self.make(unknown), strict=True))

    def join(self, units: list[str]) -> bytes:
        return b"".join(map(self.young.__getitem__, units))


class Encoder:
    """ids(text) gives the ids that the tokenizers library gives with add_special_tokens=False."""

    def __init__(self, name: str) -> None:
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.units = Held(self.new_units)

    def new_units(self, units: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(units, add_special_tokens=False)]

    def cut(self, text: str) -> list[str] | None:
        """The units of a text; none for a text that is encoded whole."""
        return None if WHOLE.search(text) else UNIT.findall(text)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def ids(self, text: str | None) -> np.ndarray:
        """Little-endian unsigned 32-bit ids of a whole text; none for a null text."""
        if not text:
            return np.empty(0, dtype="<u4")
        if (units := self.cut(text)) is None:
            return self.whole(text)
        self.units.fill(units)
        return np.frombuffer(self.units.join(units), dtype="<u4")

    def each(self, texts: list[str | None], at_once: int = 1 << 20) -> Iterator[np.ndarray]:
        """ids of each text; the units of about at_once characters are looked up together."""
        start = 0
        while start < len(texts):
            stop, n = start, 0
            while stop < len(texts) and n < at_once:
                n += len(texts[stop] or "")
                stop += 1
            cut = [self.cut(t or "") for t in texts[start:stop]]
            self.units.fill(set().union(*(u for u in cut if u)))
            for t, u in zip(texts[start:stop], cut, strict=True):
                yield self.whole(t) if u is None else np.frombuffer(self.units.join(u), dtype="<u4")
            start = stop


class ByteEncoder(Encoder):
    """Byte-level vocabulary: new units go through the same vocabulary's merge ranks, which is several times faster."""

    def __init__(self, name: str) -> None:
        super().__init__(name)
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranked = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def new_units(self, units: list[str]) -> list[bytes]:
        encode = self.ranked.encode_ordinary
        return [array("I", encode(u)).tobytes() for u in units]


class WordEncoder(Encoder):
    """Lower-casing vocabulary with word ends: a new unit's words and signs are looked up on their own first."""

    def __init__(self, name: str) -> None:
        super().__init__(name)
        self.parts = Held(self.new_parts, 2 * HELD)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[k for t, k in vocab.items() if t.endswith("</w>")]] = True

    def new_parts(self, parts: list[str], at_once: int = 2048) -> list[bytes]:
        """Words of letters are encoded many at once; each ends at the only id of a word's end."""
        found, letters = {}, [p for p in parts if p.isalpha()]
        for k in range(0, len(letters), at_once):
            some = letters[k : k + at_once]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(stops) == len(some):  # else the library sees several words in one of them
                raw = ids.tobytes()
                found.update((w, raw[s:e]) for w, s, e in zip(some, [0, *stops], stops))
        rest = [p for p in parts if p not in found]
        found.update(zip(rest, super().new_units(rest), strict=True))
        return [found[p] for p in parts]

    def cut(self, text: str) -> list[str] | None:
        """White space is dropped, so a unit is a word without it; capitals of ASCII texts fall before the look-up."""
        return None if WHOLE.search(text) else (text.lower() if text.isascii() else text).split()

    def new_units(self, units: list[str]) -> list[bytes]:
        cut = [[w.lower()] if w.isascii() and w.isalpha() else PART.findall(w.lower()) if SIMPLE.fullmatch(w) else [w] for w in units]
        self.parts.fill({p for parts in cut for p in parts})
        get = self.parts.young.__getitem__
        return [b"".join(map(get, parts)) for parts in cut]


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder of each kind for a worker's process."""
    if name not in _ENCODERS:
        kind = ByteEncoder if name.startswith("byte_") else WordEncoder if name.startswith("word_") else Encoder
        _ENCODERS[name] = kind(name)
    return _ENCODERS[name]


def forget() -> None:
    """Drops this process's encoders and their tables."""
    _ENCODERS.clear()
