"""Words of UTF-8 texts. Only A-Z are lowered; every byte from 0x80 on belongs to a word."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Letters, digits and all beyond ASCII stay, lowered; everything else becomes a space.
_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def spaced(text: bytes) -> list[bytes]:
    """Words between white space (space, tab, line feed, vertical tab, form feed, carriage return)."""
    return text.translate(_LOWER).split()


def alnum(text: bytes) -> list[bytes]:
    """Words of letters, digits and characters beyond ASCII."""
    return text.translate(_ALNUM).split()


def alnum_text(text: bytes) -> bytes:
    return text.translate(_ALNUM)


def counted(texts: DataFrame, cut: Callable[[bytes], list[bytes]], most: int = 400_000) -> DataFrame:
    """Word and count over texts(text binary): added up in each task as far as memory allows, then by word."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(n: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*n.keys()], pa.binary()), pa.array([*n.values()], pa.int64())], ["word", "n"])

        n: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                n.update(cut(t.as_py()))
                if len(n) > most:
                    yield out(n)
                    n = Counter()
        if n:
            yield out(n)

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
