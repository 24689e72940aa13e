"""Exact, cached encoding with the ``tokenizers`` library.

Byte-level and word-level BPE never merge across the start of a run of white
space, so a text may be cut before each single space without changing its ids.
The pieces repeat a lot; a worker keeps the ids of those it has met. New pieces
of Latin letters, common signs and line ends are cut as the tokenizer's own
pattern cuts them and go to the library's model directly; all others are encoded
by the whole tokenizer, many in a call. Texts where a space stands next to other
white space, and texts that may hold an added token (``<|endoftext|>``), are encoded
whole by the library's own call.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

#: Pieces whose ids one worker keeps (about 190 MB), and longest of them.
CACHE, LONGEST = 1_000_000, 64
#: Characters encoded in one call for new pieces.
CALL_CHARS = 20_000
_LATIN, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?*#$%&|"
_ENCODERS: dict = {}


def _byte_level() -> dict[int, str]:
    """The byte alphabet of byte-level BPE, keyed by Latin-1 character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Encoder:
    """Ids of texts as little-endian unsigned 16- or 32-bit integers."""

    def __init__(self, path: str, keep: int = CACHE):
        self.keep = keep
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cache: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.odd = re.compile(r" \s").search
        self.plain = re.compile(f"[{_LATIN}{_SIGNS}\n]+").fullmatch
        self.parts = re.compile(f"[{_LATIN}]+|[{_SIGNS}]+|\n").findall
        self.bytes = _byte_level()
        self.ends = {c: self._whole(c) for c in ".,;:!?"}
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        # How each added token begins, up to its first letter or digit: no normalizer makes such signs from others.
        self.added = sorted({re.match(r"[^\w\s;`]*", t["content"]).group() for t in kind.get("added_tokens") or ()})
        steps = kind.get("pre_tokenizer") or {}
        # Which of the two known patterns this is; for any other the short cut is off.
        self.spaced = steps.get("type") == "ByteLevel" and steps.get("use_regex") and not steps.get("add_prefix_space") and not kind.get("normalizer")
        self.folded = [n.get("type") for n in (kind.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [
            n.get("type") for n in steps.get("pretokenizers", [])
        ] == ["Split", "ByteLevel"]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _model(self, part: str) -> bytes:
        ids = self.known.get(part)
        if ids is None:
            word = part.encode().decode("latin-1").translate(self.bytes)
            ids = array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()
            if len(part) <= 4 and len(self.known) < 100_000:
                self.known[part] = ids
        return ids

    def _plain(self, piece: str, found: dict[str, bytes]) -> bytes:
        """Ids of `` piece`` by the model alone."""
        parts = self.parts(piece.lower() if self.folded else piece)
        first = parts[0]
        ids = self.cache.get(first) or found.get(first)
        if ids is None:
            ids = found[first] = self._model(first if self.folded else " " + first)
        for p in parts[1:]:
            if not self.folded:
                ids += self._model(p)
            elif p != "\n":
                ids += self.cache.get(p) or found.get(p) or self._model(p)
        return ids

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of `` piece`` for each new piece."""
        found, hard = {}, []
        short = (self.spaced or self.folded) and sys.byteorder == "little"
        cached, ends = self.cache.get, self.ends if short else ()
        for p in pieces:
            # A known word and a sign: the sign is cut off a letter by either pattern.
            if p[-1] in ends and p[-2:-1].isalpha() and (ids := cached(p[:-1]) or found.get(p[:-1])) is not None:
                found[p] = ids + self.ends[p[-1]]
            elif short and self.plain(p) and p[0] != "\n" and "\n\n" not in p:
                found[p] = self._plain(p, found)
            else:
                hard.append(p)
        at = 0
        while at < len(hard):  # encode a concatenation and cut it at token ends
            n, stop = 0, at
            while stop < len(hard) and (stop == at or n + len(hard[stop]) <= CALL_CHARS):
                n += len(hard[stop]) + 1
                stop += 1
            part = hard[at:stop]
            done = self.tok.encode("".join(" " + p for p in part), add_special_tokens=False)
            ids = np.array(done.ids, self.dtype)
            ends = np.fromiter((e for _, e in done.offsets), np.int64, len(ids))
            cuts = np.searchsorted(ends, np.cumsum([len(p) + 1 for p in part]), "right")
            raw, width, last = ids.tobytes(), self.dtype.itemsize, 0
            for p, c in zip(part, cuts.tolist(), strict=True):
                found[p] = raw[last * width : c * width]
                last = c
            at = stop
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null is the empty text."""
        out: list = [None] * len(texts)
        open_: list[tuple[int, list, list[int], list[str]]] = []
        new: dict[str, None] = {}
        get = self.cache.get
        for i, t in enumerate(texts):
            if not t:
                out[i] = b""
            elif t[0] == " " or t[-1] == " " or self.odd(t) or any(a in t for a in self.added):
                out[i] = self._whole(t)
            else:
                pieces = t.split(" ")
                got = list(map(get, pieces))
                got[0] = self._whole(pieces[0])
                if None in got:
                    at, holes = 0, []
                    try:
                        while True:
                            at = got.index(None, at + 1)
                            holes.append(at)
                    except ValueError:
                        pass
                    missing = [pieces[k] for k in holes]
                    new.update(dict.fromkeys(missing))
                    open_.append((i, got, holes, missing))
                else:
                    out[i] = b"".join(got)
        if open_:
            found = self._learn(list(new))
            for i, got, holes, missing in open_:
                for k, p in zip(holes, missing):
                    got[k] = found[p]
                out[i] = b"".join(got)
            if len(self.cache) < self.keep:
                self.cache.update([(p, b) for p, b in found.items() if len(p) <= LONGEST])
        return out


def encoder(path: str, keep: int = CACHE):
    """One encoder a worker process, path and number of pieces kept."""
    if (path, keep) not in _ENCODERS:
        _ENCODERS[path, keep] = Encoder(path, keep)
    return _ENCODERS[path, keep]


def forget() -> None:
    """Drop a worker's encoders and what they know."""
    _ENCODERS.clear()


def groups(texts, most: int = 1_000_000):
    """Consecutive texts in lists of about ``most`` characters."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part
