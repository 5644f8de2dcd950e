"""Encoding by pieces between single spaces, each looked up in a bounded cache.

A tokenizer's own pre-tokenizer never lets a token span a space that follows a character that is not white space, so
the pieces can be encoded one by one; where a piece touches other white space the whole text goes to the library.
"""

from __future__ import annotations

import os
import string

from tessera.llm.common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def load(path: str):
    """The tokenizer of a file, without truncation and padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _byte_symbols() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 ones stand for themselves, the
    others, in order, for those from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)}


_SYMBOLS = _byte_symbols()


def symbols(text: str) -> str:
    return text.encode().decode("latin-1").translate(_SYMBOLS)


class Pieces:
    """What is known of pieces, at most 2 * `most` of them: the younger half is looked up first, and what is found in
    the older one moves over. A new piece is taken apart where the pre-tokenizer always cuts: between letters and the
    marks behind them, and at single line feeds."""

    MARKS = string.punctuation

    def __init__(self, most: int):
        self.most, self.young, self.old, self.ends = most, {}, {}, {}

    def word(self, piece: str):
        """The value of letters."""
        raise NotImplementedError

    def lines(self, piece: str):
        """The value of a piece with line feeds."""
        raise NotImplementedError

    def other(self, piece: str):
        """The value of any piece."""
        raise NotImplementedError

    def end(self, marks: str):
        """The value of marks behind letters."""
        raise NotImplementedError

    def joined(self, value, end):
        raise NotImplementedError

    def get(self, piece: str):
        x = self.young.get(piece)
        if x is None:
            x = self.old.get(piece)
            if x is None:
                x = self._new(piece)
            self.young[piece] = x
        return x

    def _new(self, p: str):
        if p.isalpha():
            return self.word(p)
        if (q := p.rstrip(self.MARKS)) != p and q.isalpha():
            marks = p[len(q) :]
            if (end := self.ends.get(marks)) is None:
                if len(self.ends) > 10_000:
                    self.ends.clear()
                end = self.ends[marks] = self.end(marks)
            return self.joined(self.get(q), end)
        return self.lines(p) if "\n" in p else self.other(p)

    def values(self, pieces: list[str]) -> list:
        out = [*map(self.young.get, pieces)]
        if None in out:
            if len(self.young) > self.most:
                self.old, self.young = self.young, {}
            out = [self.get(p) if x is None else x for p, x in zip(pieces, out, strict=True)]
        return out


class ByteLevelEncoder(Pieces):
    """Ids of texts under a byte-level vocabulary whose pre-tokenizer attaches one leading space to a word.

    Ids are little-endian unsigned integers of `width` bytes. A piece's value is that of the piece with a space before
    it, or False where it touches other white space.
    """

    def __init__(self, path: str, most: int = 450_000):
        super().__init__(most)
        self.library = load(path)
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.model = self.library.model
        self.packed = [i.to_bytes(self.width, "little") for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.feed = self.direct("\n")

    def pack(self, ids: list[int]) -> bytes:
        return b"".join([self.packed[i] for i in ids])

    def direct(self, text: str) -> bytes:
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)

    def _letters(self, text: str) -> bytes:
        return b"".join([self.packed[t.id] for t in self.model.tokenize(symbols(text))])

    def word(self, piece: str) -> bytes:
        return self._letters(f" {piece}")

    def end(self, marks: str) -> bytes:
        return self.direct(marks)

    def joined(self, value: bytes | bool, end: bytes) -> bytes | bool:
        return value and value + end

    def other(self, piece: str) -> bytes | bool:
        return bool(piece) and not piece[0].isspace() and not piece[-1].isspace() and self.direct(f" {piece}")

    def lines(self, piece: str) -> bytes | bool:
        parts = piece.split("\n")
        if not all(x and not x[0].isspace() and not x[-1].isspace() for x in parts):
            return self.other(piece)
        return self.get(parts[0]) + b"".join([self.feed + self._bare(x) for x in parts[1:]])

    def _bare(self, text: str) -> bytes:
        q = text.rstrip(self.MARKS)
        return (self._letters(q) + (self.end(text[len(q) :]) if q != text else b"")) if q.isalpha() else self.direct(text)

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        values = self.values(rest)
        if first and first[-1].isspace() or False in values:
            return self.direct(text)
        return (self.direct(first) if first else b"") + b"".join(values)


def byte_level_encoder(path: str) -> ByteLevelEncoder:
    """One for all tasks of a Python worker, so that what it has learnt stays."""
    return held(("byte level", path), lambda: ByteLevelEncoder(path))
