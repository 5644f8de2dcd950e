"""Benchmark decontamination by a prefix-filtered set join.

An item's shingles are its windows of `width` consecutive words; an item of fewer words, but not none, is one shingle.
A shingle is only contained in a document if all its words are, so one prefix token is enough for the join: its rarest
word, by counts over all documents (ties: the smaller word). Documents are scanned once; where a word is some shingle's
prefix token, the positional bound puts the shingle's start so many words before, the length bound asks for room in the
document, and the words in between are compared one by one. Nothing is joined by hash alone, so containment is exact.

Items are a stated query set. Up to `most` bytes of item text, which is checked, their shingles go to every task. Beyond
that nothing grows on the driver or in a task: shingles stay a table, a bitmap of their prefix tokens (2 MB at most)
tells the scan which words to emit with the words around them, and these rows meet the shingles in a join by prefix
token that Spark may split where a token is hot. Either way the documents are scanned twice, to count and to search, and
results are the same.

Words: A-Z lowered, runs of letters, digits and characters beyond ASCII. Null texts have none. Empty item or document
tables give documents without hits, or no rows. Repeated document rows (same doc_id and text) are scanned each and
stay as many. Repeated items count by item_id: once; a null item_id counts as an empty one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import kept_schema, quoted, saved, text_bytes, texted, tune, utf8, without
from tessera.llm.words import alnum, counted

WIDTH, MOST_BYTES = 8, 1 << 20
#: Bits of the map of prefix tokens, where items are too many to be sent.
BITS = 24

Shingle = tuple[bytes, ...]


def shingles(words: list[bytes], width: int) -> set[Shingle]:
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def collected(items: DataFrame, width: int) -> dict[Shingle, list[str]]:
    """Shingles and their items, of items that are few enough."""
    found: dict[Shingle, set[str]] = defaultdict(set)
    for item, text in items.select(F.col("item_id").cast("string"), utf8()).toLocalIterator():
        for s in shingles(alnum(bytes(text)), width):
            found[s].add(item if item is not None else "")
    return {s: sorted(x) for s, x in found.items()}


def word_counts(docs: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """How often the items' words stand in all documents; summed in each task, then by word."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n = dict.fromkeys(wanted, 0)
        for b in batches:
            for t in b.column(0):
                for w in filter(n.__contains__, alnum(t.as_py())):
                    n[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*n], pa.binary()), pa.array([*n.values()], pa.int64())], ["word", "n"])

    found = docs.select(utf8().alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n"))
    return {bytes(w): n for w, n in found.collect()}


class Scanner:
    """Finds every occurrence of a block's shingles in a row of words."""

    def __init__(self, block: dict[Shingle, list[str]], counts: dict[bytes, int]):
        self.anchors: dict[bytes, list[tuple[int, Shingle, list[str]]]] = defaultdict(list)
        for s, items in block.items():
            at = min(range(len(s)), key=lambda i: (counts.get(s[i], 0), s[i], i))
            self.anchors[s[at]].append((at, s, items))
        self.anchors = dict(self.anchors)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint stretches of hit words, in order, and the items."""
        spans, items, n = [], set(), len(words)
        has = self.anchors
        if has.keys().isdisjoint(words):
            return spans, items
        for i, w in enumerate(words):
            if w in has:
                for at, s, found in has[w]:
                    begin = i - at
                    end = begin + len(s)
                    if begin >= 0 and end <= n and tuple(words[begin:end]) == s:
                        spans.append((begin, end))
                        items.update(found)
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_MADE = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<array<int>>"


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, min_items: int = 2, keep: list[str] | None = None, most: int = MOST_BYTES) -> DataFrame:
    """For each row of docs(doc_id, text, ...): the columns of `keep` (none that is made here), n_words, n_hit, n_items,
    items_sha256, contaminated (min_items or more), items (sorted item ids) and spans (stretches of hit words as
    [from, to) word positions)."""
    spark = docs.sparkSession
    tune(spark)
    keep = without(keep, " ".join(c.split()[0] for c in _MADE.split(", ")))
    size = items.agg(F.coalesce(F.sum(F.octet_length(utf8())), F.lit(0))).first()[0]
    if size > most:
        return _joined(docs, items, width, min_items, keep)
    found = collected(items, width)
    counts = word_counts(docs, {w for s in found for w in s}) if found else {}
    sent = spark.sparkContext.broadcast((found, counts))
    return texted(docs, keep).mapInArrow(partial(_run, sent=sent, keep=keep, min_items=min_items), kept_schema(docs, keep, _MADE))


def _joined(docs: DataFrame, items: DataFrame, width: int, min_items: int, keep: list[str]) -> DataFrame:
    """decontaminate() of more items than may be sent."""
    spark = docs.sparkSession

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = [(item or "", [*s]) for item, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for s in shingles(alnum(t.as_py()), width)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.binary()))], ["item", "shingle"])

    owned = saved(items.select(F.col("item_id").cast("string"), utf8().alias("text")).mapInArrow(cut, "item string, shingle array<binary>").distinct(), "shingles")
    every = owned.select("shingle").distinct()
    placed = every.select("shingle", F.posexplode("shingle").alias("at", "word"))
    counts = counted(docs.select(utf8().alias("text")), alnum).join(placed.select("word").distinct(), "word", "left_semi")
    first = placed.join(counts, "word", "left").groupBy("shingle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("x"))
    anchors = saved(first.select("shingle", F.col("x.word").alias("anchor"), F.col("x.at").alias("at"), F.size("shingle").alias("length")), "anchors")

    bit = lambda word: zlib.crc32(word) >> (32 - BITS)
    held = anchors.select("anchor").distinct().select(F.shiftright(F.crc32("anchor").cast("long"), 32 - BITS).alias("b"))
    bits = held.select(F.floor(F.col("b") / 32).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 32).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    map_ = np.zeros(1 << (BITS - 5), np.uint32)
    for r in bits.toLocalIterator():
        map_[r.word] = r.bits
    sent = spark.sparkContext.broadcast(map_)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        likely = sent.value
        kind = pa.list_(pa.struct([("anchor", pa.binary()), ("place", pa.int32()), ("before", pa.int32()), ("around", pa.list_(pa.binary()))]))
        for b in batches:
            n, found = [], []
            for t in text_bytes(b, keep):
                words = alnum(t.as_py())
                h = np.fromiter(map(bit, words), np.int64, len(words))
                hits = np.flatnonzero(likely[h >> 5] >> (h & 31).astype(np.uint32) & 1) if len(h) else ()
                n.append(len(words))
                found.append([{"anchor": words[i], "place": i, "before": min(i, width - 1), "around": words[max(0, i - width + 1) : i + width]} for i in map(int, hits)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(found, kind)], [*keep, "n_words", "__found"])

    made = "n_words long, `__found` array<struct<anchor:binary,place:int,before:int,around:array<binary>>>"
    scanned = saved(texted(docs, keep).mapInArrow(scan, kept_schema(docs, keep, made)).withColumn("__row", F.monotonically_increasing_id()), "scanned")
    near = scanned.select("__row", F.explode("__found").alias("f")).select("__row", "f.*")
    begin, length = F.col("before") - F.col("at"), F.col("length")
    fits = (begin >= 0) & (begin + length <= F.size("around"))
    hits = near.join(anchors, "anchor").filter(fits).filter(F.slice("around", F.greatest(begin, F.lit(0)) + 1, length) == F.col("shingle"))
    hits = saved(hits.select("__row", "shingle", (F.col("place") - F.col("at")).alias("from"), (F.col("place") - F.col("at") + length).alias("to")), "hits")
    spans = hits.groupBy("__row").agg(F.array_sort(F.collect_set(F.array("from", "to"))).alias("spans"))
    one = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)[1] >= x[0]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], x[1]))))).otherwise(F.concat(acc, F.array(x)))
    spans = spans.select("__row", F.aggregate("spans", F.array().cast("array<array<int>>"), one).alias("spans"))
    ids = hits.select("__row", "shingle").distinct().join(owned, "shingle").groupBy("__row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = scanned.drop("__found").join(spans, "__row", "left").join(ids, "__row", "left")
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast("array<array<int>>"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    return out.select(*[quoted(c) for c in keep], "n_words", total.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"), "items", "spans")


def _run(batches: Iterator, sent, keep: list[str], min_items: int) -> Iterator:
    import pyarrow as pa

    scanner = Scanner(*sent.value)
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int32()))]
    for b in batches:
        out = []
        for t in text_bytes(b, keep):
            words = alnum(t.as_py())
            spans, items = scanner.scan(words)
            ids = sorted(items)
            out.append((len(words), sum(y - x for x, y in spans), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids) >= min_items, ids, [[*s] for s in spans]))
        columns = [*zip(*out, strict=True)] if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [*keep, *names])
