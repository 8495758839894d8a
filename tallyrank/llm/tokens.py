"""Encoding whole texts with a public tokenizer inside tasks.

A byte-level pre-tokenizer starts a new piece wherever white space follows other characters,
so a text may be cut there and every part encoded by itself. Parts repeat far more often than
texts do: each worker keeps the ids of parts it has met, in two tables of bounded size. A full table
becomes the older one, and what is met again there moves to the newer, so frequent parts stay.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array

import numpy as np

END_ID = 2
#: Entries of each of the two tables of a worker.
CACHE = 350_000
#: White space as the tokenizer's own pattern has it (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PART = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Parts longer than this are encoded but not kept.
KEEP_CHARS = 64
#: ASCII symbols that end a part and form a piece of their own behind letters. The apostrophe
#: is left out, since the pre-tokenizer has endings that begin with it.
MARKS = string.punctuation.replace("'", "")


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest is moved up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(moved)}


_encoders: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.width = np.dtype("<u2" if self.model.get_vocab_size() <= 65536 else "<u4")
        self.code = {2: "H", 4: "I"}[self.width.itemsize]
        self.merges = self.model.model
        self.letters = byte_letters()
        self.space, self.line = chr(self.letters[32]), chr(self.letters[10])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of letters with at most one space before them, or of marks: one piece for the
        pre-tokenizer, so the merges alone decide."""
        got = self._kept(piece)
        if got is None:
            if piece.isascii():  # of these only white space is moved in the byte-level alphabet
                mapped = piece.replace(" ", self.space).replace("\n", self.line)
            else:
                mapped = piece.encode().decode("latin-1").translate(self.letters)
            got = self.known[piece] = self._bytes([t.id for t in self.merges.tokenize(mapped)])
        return got

    def _kept(self, part: str) -> bytes | None:
        got = self.known.get(part)
        if got is None:
            got = self.older.get(part)
            if got is not None:
                self.known[part] = got
        return got

    def _part(self, part: str) -> bytes:
        stem = part.rstrip(MARKS)
        tail = part[len(stem):]
        lead = stem[:1]
        word = stem[1:] if lead in (" ", "\n") else stem
        if word.isalpha() and len(word) <= KEEP_CHARS:
            got = self._piece("\n") + self._piece(word) if lead == "\n" else self._piece(stem)
            return got + self._piece(tail) if tail else got
        if tail and stem in ("", " ") and len(tail) <= KEEP_CHARS:
            return self._piece(part)
        return self._bytes(self.model.encode(part, add_special_tokens=False).ids)

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of the text, little-endian, `width` bytes each."""
        parts = PART.findall(text)
        if len(self.known) >= CACHE:
            self.known, self.older = {}, self.known
        known = self.known
        got = list(map(known.get, parts))
        if None in got:
            for i, v in enumerate(got):
                if v is None:
                    part = parts[i]
                    v = self._kept(part)
                    if v is None:
                        v = self._part(part)
                        if len(part) <= KEEP_CHARS:
                            known[part] = v
                    got[i] = v
        return b"".join(got)

    def ids(self, text: str, end: int | None = END_ID) -> np.ndarray:
        """Ids as unsigned 32-bit integers, with the end id."""
        got = np.frombuffer(self.encode(text), self.width).astype("<u4")
        return got if end is None else np.append(got, np.uint32(end)).astype("<u4")


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
