"""MinHash near-duplicates with odd sketches.

A document's set is its distinct shingles of `width` words (A-Z lowered, split at white space), as 64-bit hashes; with
fewer words, the whole sequence is the one shingle. Documents with equal sets are one class, its smallest doc_id stands
for it. From each class come `bands` * `rows` MinHash samples. Equal bands put classes into a bucket; the samples folded
into a bitmap of parities (the odd sketch) estimate the similarity of two classes from the population count of the
bitmaps' XOR, and pairs far below the threshold are dropped there. All others are confirmed on their full sets: linked
if 100 * intersection >= percent * union.

No bucket's pairs are all written. First every member is held against the bucket's most central member, the one whose
bands have most company, then, where a bucket still has several components, against its least central one. What is left
are members that are near others in some places but not linked to the middle of their group. For them the rest is exact:
two sets with a similarity of s share one of the first n - ceil(s * n) + 1 shingles of each, in any order of shingles,
so with the rarest first (counted over what is left) a much edited text, whose first shingles are its own, meets nobody;
others meet by shingle, under bounds of length and position, and only across components. So a pair of a bucket is in one
component already, or is tested, or cannot be a link, and none is lost. Components are computed by distributed stars.
Bands miss a pair at the threshold with probability (1 - s**rows)**bands, 2e-6 at 0.85 and 1e-5 at 0.8. The sketch drops
only pairs so far below the threshold that a true link fails it less than once in 1e7; of bands of four samples few such
pairs come, so it saves little here, and the full sets decide the rest.

Documents without words are linked with nothing. Rows of one doc_id are one document: any of its sets links it. A null
doc_id is linked with nothing, its component is null and it is kept. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import held, marked, saved, tune, utf8
from tessera.llm.graph import components
from tessera.llm.words import spaced

WIDTH, PERCENT, ROWS, BITS, SEED = 5, 80, 4, 512, 1
#: Bands of four samples: at 0.8 a pair is missed with probability 1e-5, at 0.85 with 2e-6.
BANDS = {80: 22, 85: 18}

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_S29, _S32 = np.uint64(29), np.uint64(32)


class Sets:
    """Shingle sets of texts. At most `most` words' hashes are kept."""

    def __init__(self, width: int, most: int = 250_000):
        self.width, self.most, self.hash = width, most, {}

    def of(self, text: bytes) -> np.ndarray:
        """Sorted distinct shingles."""
        words = spaced(text)
        if not words:
            return np.empty(0, np.uint64)
        try:
            h = np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(self.hash) > self.most:
                self.hash.clear()
            for w in set(words).difference(self.hash):
                self.hash[w] = xxhash.xxh64_intdigest(w)
            h = np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))
        n = min(self.width, len(h))
        x = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            x += h[i : len(h) - n + 1 + i]
            x *= _K[i % 3]
            x ^= x >> (_S29 if i % 2 else _S32)
        return np.unique(x)


def set_maker(width: int) -> Sets:
    """One for all tasks of a Python worker."""
    return held(("sets", width), lambda: Sets(width))


class Signer:
    def __init__(self, bands: int, rows: int, bits: int, seed: int):
        r = np.random.default_rng(seed)
        self.bands, self.rows, self.bits = bands, rows, bits
        self.a = r.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.b = r.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.place = r.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)

    def samples(self, x: np.ndarray) -> np.ndarray:
        """The smallest hashed shingle of each of the hash functions."""
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(x), 4096):
            part = (x[i : i + 4096, None] ^ self.b) * self.a
            np.minimum(out, part.min(0), out=out)
        return out

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """One key for each band."""
        m = samples.reshape(self.bands, self.rows)
        x = np.arange(1, self.bands + 1, dtype=np.uint64) * _K[2]
        for i in range(self.rows):
            x = (x + m[:, i]) * _K[i % 3]
            x ^= x >> _S32
        return x.view(np.int64)

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        """Bitmap of parities: each sample flips one bit."""
        at = ((samples ^ (samples >> _S29)) * self.place) >> np.uint64(64 - int(self.bits).bit_length() + 1)
        odd = np.bincount(at.astype(np.int64), minlength=self.bits) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)


def estimate(left: Column, right: Column, samples: int, bits: int) -> Column:
    """Similarity from two odd sketches; 0 where too many bits differ to tell."""
    differ = F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return F.when(2 * differ >= bits, 0.0).otherwise(1 + F.log(1 - 2.0 * differ / bits) * (bits / (4.0 * samples)))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int | None = None, rows: int = ROWS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_shingles, component_id, kept (it is the smallest id of its own)."""
    tune(docs.sparkSession)
    bands = bands or BANDS.get(percent) or _bands(percent, rows)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    signed = saved(source.mapInArrow(lambda x: _sign(x, width, bands, rows, bits, seed), "doc_id long, n long, digest binary, keys array<long>, sketch array<long>"), "signed")
    there = signed.filter("n > 0 and doc_id is not null")
    # aggregates by a key that may be hot are written before they are joined: Spark can split a join of plain tables
    heads = there.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "keys", "sketch")).alias("x"))
    # h tells the sets of an id with several texts apart
    heads = saved(heads.select("digest", F.xxhash64("digest").alias("h"), F.col("x.doc_id").alias("rep"), "x.n", "x.keys", "x.sketch"), "heads")
    classes = heads.select("digest", "rep")
    # most classes share no band, so sketches stay behind until pairs are known
    dealt = heads.select("rep", "h", "n", F.explode("keys").alias("key"))
    shared = saved(dealt.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "shared")
    members = saved(dealt.join(shared, "key"), "members")
    candidates = saved(members.select(F.col("rep").alias("k")).distinct(), "candidates")
    some = marked(source, F.col("doc_id"), candidates).filter("__hit").drop("__hit")
    sketches = saved(heads.select("rep", "h", "sketch").join(candidates, F.col("rep") == F.col("k"), "left_semi"), "sketches")
    sets = saved(some.join(candidates, some.doc_id == candidates.k, "left_semi").mapInArrow(lambda x: _sets(x, width), "rep long, set array<long>"), "sets")
    # an id with several texts ties their classes together
    several = there.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y").select("doc_id")
    links = saved(there.select("doc_id", "digest").join(several, "doc_id", "left_semi").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "links")
    company = members.groupBy("rep").agg(F.sum("members").alias("company"))
    open_ = saved(members.join(company, "rep").withColumn("component", F.col("rep")), "open")
    found = None
    for step, order in enumerate((F.struct(-F.col("company"), F.col("rep")), F.struct(F.col("company"), -F.col("rep")))):
        pick = open_.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("rep").alias("l_rep"), F.col("h").alias("l_h"), F.col("n").alias("l_n"), F.col("component").alias("l_component"))).alias("x")).select("key", "x.l_rep", "x.l_h", "x.l_n", "x.l_component")
        paired = open_.join(saved(pick, "hubs"), "key").filter("component <> l_component")
        links = saved(links.unionAll(_confirmed(paired, sketches, sets, percent, bands * rows, bits)), "links")
        found = components(links)
        known = open_.drop("component").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed = known.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
        mixed = saved(mixed, "mixed")
        # of two or three members, these steps hold each against each
        open_ = saved(known.filter(F.col("members") > step + 2).join(mixed, "key", "left_semi"), "open")
        if open_.isEmpty():
            break
    else:
        links = saved(links.unionAll(_verified(_by_prefix(open_, sets, percent), sets, percent)), "links")
        found = components(links)
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(classes, "digest", "left")
    out = out.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents that are near-duplicates of one with a smaller id. Of several rows with a kept id the
    smallest text stays. Only rows that a bitmap can't tell from those that go, or repeat an id, meet in an exchange."""
    found = saved(near_duplicates(docs, **options).select("doc_id", "kept"), "found")
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("k"))
    again = found.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("k")).agg(F.count("*").alias("n")).filter("n > 1").select("k")
    special = saved(gone.select("k", F.lit(True).alias("goes")).distinct().unionAll(again.select("k", F.lit(False).alias("goes"))), "special")
    split = marked(docs, F.col("doc_id"), special.select("k"))
    doubtful = split.filter("__hit").drop("__hit").join(special.withColumnsRenamed({"k": "__k", "goes": "__goes"}), F.col("doc_id") == F.col("__k"), "left").filter(~F.coalesce("__goes", F.lit(False)))
    single = doubtful.filter("__k is null").drop("__k", "__goes")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    repeated = doubtful.filter("__k is not null").withColumn("__place", first).filter("__place = 1").drop("__place", "__k", "__goes")
    return split.filter("not __hit").drop("__hit").unionByName(single).unionByName(repeated)


def _bands(percent: int, rows: int) -> int:
    """As many as make a miss at the threshold rarer than 1e-5."""
    s = min(percent / 100, 0.999)
    return int(np.ceil(np.log(1e-5) / np.log(1 - s**rows)))


def _confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int, samples: int, bits: int) -> DataFrame:
    """Links a, b among pairs(rep, h, n, l_rep, l_h, l_n)."""
    fits = 100 * F.least("n", "l_n") >= percent * F.greatest("n", "l_n")
    fitting = pairs.filter(fits).select(F.col("l_rep").alias("a"), F.col("l_h").alias("ah"), F.col("rep").alias("b"), F.col("h").alias("bh")).distinct()
    drawn = lambda end: sketches.select(F.col("rep").alias(end), F.col("h").alias(f"{end}h"), F.col("sketch").alias(f"{end}_sketch"))
    both = fitting.join(drawn("a"), ["a", "ah"]).join(drawn("b"), ["b", "bh"])
    # far enough below the threshold that a true link fails it less than once in 1e7
    likely = estimate(F.col("a_sketch"), F.col("b_sketch"), samples, bits) >= percent / 100 - 0.3
    return _verified(both.filter(likely).select("a", "b").distinct(), sets, percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs(a, b) whose full sets are near enough."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("t")), "b")
    common = F.size(F.array_intersect("s", "t")).cast("long")
    return both.filter(100 * common >= percent * (F.size("s") + F.size("t") - common)).select("a", "b")


def _by_prefix(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of members(rep, component) of different components that may be links: see above. A set's shingles that
    no other set here has come first in the order and meet nobody, so they are only counted."""
    own = sets.join(members.select("rep", "component").distinct(), "rep").select("rep", "component", F.size("set").cast("long").alias("n"), F.xxhash64("set").alias("sid"), "set")
    tokens = saved(own.select("rep", "sid", "component", "n", F.explode("set").alias("token")), "tokens")
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    placed = tokens.join(common, "token")
    of_rep = Window.partitionBy("rep", "sid")
    placed = placed.withColumn("at", F.col("n") - F.count("*").over(of_rep) + F.row_number().over(of_rep.orderBy("df", "token")) - 1)
    # so many shingles may lie before the first that a linked set shares
    prefix = saved(placed.filter(100 * (F.col("n") - F.col("at")) >= percent * F.col("n")).select("token", "rep", "component", "n", "at"), "prefix")
    sizes = prefix.groupBy("token", "component").agg(F.count("*").alias("m"), F.min("n").alias("least"))
    # of a shingle's components the largest stands on one side alone, so its inner pairs are never looked at
    sides = sizes.groupBy("token").agg(F.max(F.struct("m", "component")).alias("x"), F.min("least").alias("least"), F.count("*").alias("several")).filter("several > 1").select("token", F.col("x.component").alias("main"), "least")
    enough = lambda left, n, other: (100 + percent) * left >= percent * (n + other)
    # written, so that the last join reads plain tables and Spark can split a very common shingle's side
    left = prefix.join(saved(sides, "sides"), "token").filter((F.col("component") != F.col("main")) & enough(F.col("n") - F.col("at"), F.col("n"), F.col("least")))
    left = saved(left.select("token", F.col("rep").alias("a"), F.col("component").alias("a_component"), F.col("n").alias("a_n"), F.col("at").alias("a_at")), "left")
    right = prefix.select("token", F.col("rep").alias("b"), F.col("component").alias("b_component"), F.col("n").alias("b_n"), F.col("at").alias("b_at"))
    near = (F.col("a_component") != F.col("b_component")) & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    near = near & enough(F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")), F.col("a_n"), F.col("b_n"))
    return left.join(right, (left.token == right.token) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sign(batches: Iterator, width: int, bands: int, rows: int, bits: int, seed: int) -> Iterator:
    import pyarrow as pa

    sets, signer = set_maker(width), Signer(bands, rows, bits, seed)
    for b in batches:
        n, digests, keys, sketches = [], [], [], []
        for t in b.column(1):
            x = sets.of(t.as_py())
            n.append(len(x))
            digests.append(xxhash.xxh3_128_digest(x.tobytes()))
            if len(x):
                samples = signer.samples(x)
                keys.append(signer.keys(samples))
                sketches.append(signer.sketch(samples))
            else:
                keys.append(None)
                sketches.append(None)
        long = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, long), pa.array(sketches, long)], ["doc_id", "n", "digest", "keys", "sketch"])


def _sets(batches: Iterator, width: int) -> Iterator:
    import pyarrow as pa

    sets = set_maker(width)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sets.of(t.as_py()).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], ["rep", "set"])
