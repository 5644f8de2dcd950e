"""Statistics of a document's whole text, for the quality classifier."""

from __future__ import annotations

import numpy as np

#: Classes of code points below this one are looked up; all beyond count as letters.
_TABLE = 0x3000
_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _QUOTE, _SYMBOL = range(9)


def _classes() -> np.ndarray:
    out = np.empty(_TABLE + 1, np.uint8)
    for i in range(_TABLE):
        c = chr(i)
        out[i] = (
            _LINE if c == "\n" else _SPACE if c.isspace() else _UPPER if c.isupper() else _LOWER if c.isalpha() else _DIGIT if c.isdigit() else _STOP if c in ".,;:!?" else _QUOTE if c in "'\"()-" else _SYMBOL if c.isprintable() else _OTHER
        )
    out[_TABLE] = _LOWER
    return out


_CLASS = _classes()
NAMES = ["log_chars", "log_words", "upper", "digits", "symbols", "stops", "quotes", "odd", "exclaims", "pipes", "lines_per_word", "word_length", "word_spread", "distinct_words", "repeated_next", "repeated_lines", "repeated_pairs", "symbol_words", "stop_words", "long_words", "top_word"]


def statistics(text: str) -> np.ndarray:
    """One row of NAMES; an empty text has zeros. Shares are of characters, words or lines."""
    n = len(text)
    if not n:
        return np.zeros(len(NAMES))
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    share = np.bincount(_CLASS[np.minimum(points, _TABLE)], minlength=9) / n
    words = text.split()
    m = len(words) or 1
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1)
    distinct = set(words)
    last = [w[-1:] for w in words]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    pairs = len({*zip(words, words[1:], strict=False)}) if len(words) > 1 else 1
    same = sum(map(str.__eq__, words, words[1:]))
    symbol_words = sum(not x.isalnum() and x not in ".,;:!?" for x in last)
    return np.array([
        np.log1p(n), np.log1p(len(words)), share[_UPPER], share[_DIGIT], share[_SYMBOL], share[_STOP], share[_QUOTE], share[_OTHER],
        text.count("!") / m, text.count("|") / m, len(lines) / m, lengths.mean(), lengths.std(), len(distinct) / m, same / m,
        1 - len(set(lines)) / len(lines) if lines else 0.0, 1 - pairs / max(1, len(words) - 1), symbol_words / m,
        sum(x in ".,;:!?" for x in last) / m, float((lengths > 25).mean()), max(counts.values(), default=0) / m,
    ])
