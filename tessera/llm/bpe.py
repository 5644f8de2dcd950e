"""BPE encoding and decoding by tree concatenation.

A text is cut between single spaces, where the pre-tokenizer always cuts (a vocabulary file with another kind of
pre-tokenizer has no such cuts, and its texts are one piece each); each piece is encoded once and cached. Inside a piece
the library's normalizer and pre-tokenizer give the units that BPE sees. A unit of more than `leaf` symbols is unsplit
text for the tree: its leaves are encoded each by itself, without the end-of-word mark but for the last, and are then
joined pairwise. Leaves of a unit of THREADED or more go to the library as one batch, which it encodes on as many
threads as a Spark task has cores (spark.task.cpus); shorter units aren't worth a thread. At a join the tokens next to it, first one on either side, then two,
four ..., are encoded again as one window, until the window begins with the token it began with on the left and ends
with the token it ended with on the right. All neighbours in the joined row then stand as BPE itself would leave them,
so the result is exact: a row of tokens is the encoding of its text if each two neighbours are that of theirs.

Null and empty texts have no tokens. Repeated rows are encoded each. Texts may be of any length: memory holds one Arrow
batch, a bounded cache and one text's tokens.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.chunks import Pieces, load, symbols
from tessera.llm.common import held, kept_schema, text_bytes, texted, tune, without

LEAF, THREADED = 12, 1_024
Entry = tuple[int, str, str] | bool


class TreeEncoder(Pieces):
    """Tokens of units and texts under a BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str, leaf: int = LEAF, most: int = 100_000):
        if leaf < 1:
            raise ValueError("a leaf has one symbol at least")
        super().__init__(most)
        self.path, self.leaf = path, leaf
        self.library = load(path)
        self.names = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.decimals = [*map(str, range(len(self.names)))]
        self.model = self.library.model
        self.joins = 0
        self.spaces = _cuts_at_spaces(self.library)

    @cached_property
    def _inner(self):
        """The same merges without the mark that ends a word: for all but a unit's last part."""
        from tokenizers import Tokenizer

        kept = json.loads(self.library.to_str())
        kept["model"]["end_of_word_suffix"] = None
        kept |= {"normalizer": None, "pre_tokenizer": None, "added_tokens": [], "post_processor": None}
        return Tokenizer.from_str(json.dumps(kept))

    @cached_property
    def _outer(self):
        from tokenizers import Tokenizer

        kept = json.loads(self.library.to_str()) | {"normalizer": None, "pre_tokenizer": None, "added_tokens": [], "post_processor": None}
        return Tokenizer.from_str(json.dumps(kept))

    @cached_property
    def _suffix(self) -> str:
        return json.loads(self.library.to_str())["model"].get("end_of_word_suffix") or ""

    def _parts(self, parts: list[str], last: bool) -> list[list[str]]:
        """Tokens of parts; the last one ends the unit if `last`."""
        inner = parts[:-1] if last else parts
        if len(inner) >= THREADED:
            out = [e.tokens for e in self._inner.encode_batch(inner, add_special_tokens=False)]
        else:
            out = [[t.value for t in self._inner.model.tokenize(p)] for p in inner]
        return [*out, [t.value for t in self.model.tokenize(parts[-1])]] if last else out

    def _text(self, tokens: list[str], last: bool) -> str:
        joined = "".join(tokens)
        return joined[: len(joined) - len(self._suffix)] if last and self._suffix else joined

    def _join(self, left: list[str], right: list[str], last: bool) -> list[str]:
        """Tokens of two neighbouring stretches' text. last: the right one ends the unit."""
        size = 1
        self.joins += 1
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            ends = last and b == len(right)
            (window,) = self._parts([self._text(left[a:], False) + self._text(right[:b], ends)], ends)
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return [*left[:a], *window, *right[b:]]
            size *= 2

    def unit(self, row: str) -> list[str]:
        """Tokens of one unit of byte symbols, as the pre-tokenizer gives it."""
        if len(row) <= self.leaf:
            return [t.value for t in self.model.tokenize(row)]
        rows = self._parts([row[i : i + self.leaf] for i in range(0, len(row), self.leaf)], True)
        while len(rows) > 1:
            ends = len(rows) - 1
            rows = [self._join(rows[i], rows[i + 1], i + 1 == ends) if i < ends else rows[i] for i in range(0, len(rows), 2)]
        return rows[0]

    def tokens(self, piece: str) -> list[str]:
        """Tokens of a piece without its special tokens' strings."""
        shape = self.library
        text = shape.normalizer.normalize_str(piece) if shape.normalizer else piece
        units = shape.pre_tokenizer.pre_tokenize_str(text) if shape.pre_tokenizer else [(text, None)]
        return [t for u, _ in units for t in self.unit(u)]

    @cached_property
    def _special(self) -> list[str]:
        return [t.content for t in self.library.get_added_tokens_decoder().values()]

    def word(self, piece: str) -> Entry:
        text = piece.lower() if piece.isascii() else self.library.normalizer.normalize_str(piece)
        if len(text) > self.leaf or not text.isalpha():
            return self.other(piece)
        return self.entry([t.id for t in self.model.tokenize(symbols(text))])  # one unit

    def other(self, piece: str) -> Entry:
        if any(s in piece for s in self._special):
            return self.entry(self.library.encode(piece, add_special_tokens=False).ids)
        return self.entry([*map(self.library.token_to_id, self.tokens(piece))])

    def end(self, marks: str) -> Entry:
        return self.other(marks)

    def lines(self, piece: str) -> Entry:
        out: Entry = False
        for x in filter(None, map(self.get, piece.split("\n"))):
            out = self.joined(out, x)
        return out

    def entry(self, ids: list[int]) -> Entry:
        """Number of ids, decimal ids and tokens, each joined by one space; False for none."""
        return (len(ids), " ".join([self.decimals[i] for i in ids]), " ".join([self.names[i] for i in ids])) if ids else False

    def joined(self, value: Entry, end: Entry) -> Entry:
        return (value[0] + end[0], f"{value[1]} {end[1]}", f"{value[2]} {end[2]}") if value and end else value or end

    def encode(self, text: str) -> tuple[int, str, str]:
        """What entry() gives of the text's ids."""
        parts = self.values(text.split(" ") if self.spaces else [text])
        if False in parts:
            parts = [x for x in parts if x]
        if not parts:
            return 0, "", ""
        n, ids, tokens = zip(*parts, strict=True)
        return sum(n), " ".join(ids), " ".join(tokens)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids, skip_special_tokens=False)


def _cuts_at_spaces(library) -> bool:
    """Whether the file's pre-tokenizer is one that cuts at every space, and its normalizer keeps spaces and what is
    around them apart."""
    shape = json.loads(library.to_str())
    nested = lambda x, name: x.get(name) or [x]
    cutters = [p for p in nested(shape.get("pre_tokenizer") or {}, "pretokenizers")]
    spaced = any(p.get("type") in ("BertPreTokenizer", "Whitespace", "WhitespaceSplit") or p.get("type") == "Split" and p.get("behavior") == "Removed" for p in cutters)
    kinds = {n.get("type") for n in nested(shape.get("normalizer") or {}, "normalizers")}
    return spaced and kinds <= {None, "NFC", "NFKC", "Lowercase", "Replace", "BertNormalizer"}


def tree_encoder(path: str, leaf: int, threads: int = 1) -> TreeEncoder:
    """One for all tasks of a Python worker."""
    if threads > 1:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
    return held(("tree", path, leaf), lambda: TreeEncoder(path, leaf))


def encode_decode(docs: DataFrame, vocabulary: str, keep: list[str] | None = None, with_ids: bool = False, leaf: int = LEAF) -> DataFrame:
    """For each row of docs(doc_id, text, ...): the columns of `keep` (doc_id where none are named; none that is made
    here), n_tokens, ids_sha256 and
    decoded_sha256, and with with_ids the ids themselves. Decoded text is what the file's own decoder gives; where the
    file names none, the library joins the tokens by one space. One pass over the rows, no exchange."""
    tune(docs.sparkSession)
    keep = without(keep, "n_tokens ids_sha256 decoded_sha256 ids")
    schema = kept_schema(docs, keep, ", ".join(["n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<int>"] * with_ids]))

    threads = int(docs.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = tree_encoder(vocabulary, leaf, threads)
        joins = json.loads(encoder.library.to_str()).get("decoder") is None
        for b in batches:
            out: list[list] = [[], [], [], []]
            for n, ids, tokens in map(encoder.encode, text_bytes(b, keep).cast(pa.string()).to_pylist()):
                decoded = tokens if joins else encoder.decode([*map(int, ids.split())])
                for column, x in zip(out, (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), np.fromstring(ids, np.int32, sep=" ") if with_ids else None), strict=True):
                    column.append(x)
            made = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), *[pa.array(out[3], pa.list_(pa.int32()))] * with_ids]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return texted(docs, keep).mapInArrow(run, schema)
