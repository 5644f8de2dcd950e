"""LM scoring by a hidden Markov model over words.

A text is its words (A-Z lowered, split at white space) and one end. Counts of all training words are made in each
task, then by word. The model's symbols are the end, the `symbols` most frequent words, and `buckets` classes that the
crc32 of every other word picks; inside a class, a word w has (c(w)+1) / (N+V+1), with the class's tokens N and distinct
words V, so one share is left for words never seen. Latent states emit symbols.

Training: `rounds` rounds of Baum-Welch from a seeded random start; expected counts are summed across partitions in a
tree. The last `whole` rounds take all training texts, those before them one of `shares` shares of all texts in turn (by
a hash, so a share grows with the input and every text takes part): a share says enough to part the states, which is what
early rounds do, and the whole then settles them. Texts are turned into symbols once and written, in the order of their
shares, for the rounds and for scoring.
Scoring: the scaled forward recursion gives each text's exact log likelihood, to which the words' shares of their
classes are added. Both recursions take many texts side by side; a long text is cut into stretches that stand side by
side too, joined exactly by the matrices that carry states across them, so its memory has a bound.

Words' counts come from two places: the `head` most frequent words of up to 64 bytes are sent to the tasks (at most
head * 64 bytes), all others are joined by word, summed by text beforehand. The join's keys are rarer than any word of
the head, so none is hot but for very long words, whose side of the join Spark splits.

Null and empty texts are one end. Without training rows all counts are 0 and the model falls back to the base score's
form. Repeated rows and ids count and are scored each; a null doc_id is never held out. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import saved, slot, tree_sum, tune, utf8
from tessera.llm.words import counted, spaced

HEAD, SYMBOLS, BUCKETS, STATES, ROUNDS, WHOLE, SHARES = 65_536, 4_095, 1_024, 6, 14, 4, 8
#: Tokens whose weights a recursion holds at once, and the longest stretch of a text that is one row there.
BLOCK, SEGMENT = 1_000_000, 2_048
#: Texts, or tokens, that are gathered for one call of a recursion.
TEXTS, TOKENS = 8_192, 2_000_000


@dataclass
class Model:
    begin: np.ndarray  # states
    move: np.ndarray  # states, states
    emit: np.ndarray  # symbols, states

    def packed(self) -> np.ndarray:
        return np.concatenate([self.begin, self.move.ravel(), self.emit.ravel()])

    @staticmethod
    def unpacked(x: np.ndarray, states: int) -> Model:
        a, b = states, states + states * states
        return Model(x[:a], x[a:b].reshape(states, states), x[b:].reshape(-1, states))


def groups(lengths: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Indices of stretches, longest first, at most `most` tokens together (or one stretch)."""
    order = np.argsort(-lengths, kind="stable")
    total = np.cumsum(lengths[order])
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield order[at:end]
        at = end


class Rows:
    """Stretches side by side: at each step the next symbol of all that are long enough. Flat arrays hold step after
    step; step t has the first active[t] stretches, from offset[t] on."""

    def __init__(self, stretches: list[np.ndarray]):
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        self.steps, self.lengths = int(lengths[0]), lengths
        self.active = np.searchsorted(-lengths, -np.arange(self.steps), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        self.symbols = np.empty(self.offset[-1], np.int32)
        for i, x in enumerate(stretches):
            self.symbols[self.offset[: len(x)] + i] = x

    def at(self, t: int, n: int | None = None) -> slice:
        """Step t, or its first n stretches."""
        return slice(self.offset[t], self.offset[t] + (self.active[t] if n is None else n))


def transfers(model: Model, stretches: list[np.ndarray], first: list[bool], kind: type) -> np.ndarray:
    """For each stretch the matrix, up to a factor, by which it carries the states' weights from before it to its end;
    the first stretch of a text has no move before its first symbol."""
    k = len(model.begin)
    order = sorted(range(len(stretches)), key=lambda i: -len(stretches[i]))
    rows = Rows([stretches[i] for i in order])
    # a symbol's largest share is 1, so a few steps need no scaling
    emit = np.ascontiguousarray((model.emit / model.emit.max(1, keepdims=True)).T.astype(kind))
    move = model.move.astype(kind)
    now = np.where(np.array(first)[order][:, None, None], np.eye(k, dtype=kind), move)
    now *= emit[:, rows.symbols[rows.at(0)]].T[:, None, :]
    moved = np.empty_like(now)
    for t in range(1, rows.steps):
        n = rows.active[t]
        np.matmul(now[:n].reshape(-1, k), move, out=moved[:n].reshape(-1, k))
        np.multiply(moved[:n], emit.take(rows.symbols[rows.at(t)], axis=1).T[:, None, :], out=now[:n])
        if t % 4 == 0:
            now[:n] /= now[:n].max((1, 2))[:, None, None]
    out = np.empty_like(now)
    out[order] = now / now.max((1, 2))[:, None, None]
    return out


@dataclass
class Cut:
    """Stretches of texts, at most `segment` symbols each. A text that is longer is several of them, which are computed
    side by side: `before` has the states' weights at the end of the stretch before (None for a text's first one) and
    `behind` what follows makes of each state at a stretch's end (None for a text's last one). Both come from the
    stretches' transfer matrices, so cutting changes no result."""

    stretches: list[np.ndarray]
    text: list[int]
    before: list[np.ndarray | None]
    behind: list[np.ndarray | None]

    @staticmethod
    def of(model: Model, texts: list[np.ndarray], kind: type, segment: int, block: int) -> Cut:
        out = Cut([], [], [], [])
        long: list[tuple[int, list[np.ndarray]]] = []
        for i, x in enumerate(texts):
            if len(x) > segment:
                long.append((i, [x[at : at + segment] for at in range(0, len(x), segment)]))
            else:
                out.stretches.append(x)
                out.text.append(i)
        out.before, out.behind = [None] * len(out.text), [None] * len(out.text)
        pieces = [(x, j == 0) for _, cut in long for j, x in enumerate(cut)]
        size = max(1, block // segment)
        matrices = [m for at in range(0, len(pieces), size) for m in transfers(model, *map(list, zip(*pieces[at : at + size], strict=True)), kind)]
        for i, cut in long:
            own, matrices = matrices[: len(cut)], matrices[len(cut) :]
            weights, follows = model.begin.astype(kind), np.ones(len(model.begin), kind)
            before, behind = [None], [None]
            for m in own[:-1]:
                weights = weights @ m
                weights = weights / weights.sum()
                before.append(weights)
            for m in own[:0:-1]:
                follows = m @ follows
                follows = follows / follows.sum()
                behind.append(follows)
            out.stretches += cut
            out.text += [i] * len(cut)
            out.before += before
            out.behind += behind[::-1]
        return out

    def grouped(self, block: int) -> Iterator[tuple[np.ndarray, Rows]]:
        for g in groups(np.fromiter(map(len, self.stretches), np.int64, len(self.stretches)), block):
            yield g, Rows([self.stretches[i] for i in g])

    def starts(self, model: Model, g: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The weights that a group's first symbols meet, which stretches go on with a text, and these ones' weights at
        the end of the stretch before."""
        inner = np.array([i for i, j in enumerate(g) if self.before[j] is not None], np.int64)
        start = np.repeat(model.begin.astype(kind)[:, None], len(g), 1)
        before = np.stack([self.before[g[i]] for i in inner], 1) if len(inner) else np.empty((len(start), 0), kind)
        start[:, inner] = model.move.T.astype(kind) @ before
        return start, inner, before


def likelihoods(model: Model, texts: list[np.ndarray], segment: int = SEGMENT, block: int = BLOCK) -> np.ndarray:
    """Natural log likelihood of each text, by the scaled forward recursion."""
    out = np.zeros(len(texts))
    emit, forth = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    cut = Cut.of(model, texts, float, segment, block)
    for g, rows in cut.grouped(block):
        a, _, _ = cut.starts(model, g, float)
        logs = np.zeros(len(g))
        emits, scale = emit.take(rows.symbols, axis=1), np.empty(len(rows.symbols))
        for t, n in enumerate(rows.active):
            if t:
                a = forth @ a[:, :n]
            a *= emits[:, rows.at(t)]
            a /= np.add.reduce(a, 0, out=scale[rows.at(t)])
        np.log(scale, out=scale)
        for t, n in enumerate(rows.active):
            logs[:n] += scale[rows.at(t)]
        np.add.at(out, np.array(cut.text)[g], logs)
    return out


def expected(model: Model, texts: list[np.ndarray], segment: int = SEGMENT, block: int = BLOCK, kind: type = np.float32) -> tuple[Model, float]:
    """Baum-Welch counts of texts and their log likelihood. Memory holds `block` tokens' weights, however long a text
    is. Recursions are scaled at every step, so single precision is enough; sums are in double precision."""
    k, m = len(model.begin), len(model.emit)
    found, score = Model(np.zeros(k), np.zeros((k, k)), np.zeros((m, k))), 0.0
    emit, move = np.ascontiguousarray(model.emit.T.astype(kind)), model.move.astype(kind)
    forth = np.ascontiguousarray(move.T)
    cut = Cut.of(model, texts, kind, segment, block)
    for g, rows in cut.grouped(block):
        now, inner, before = cut.starts(model, g, kind)
        emits = emit.take(rows.symbols, axis=1)
        alphas, betas, scale = np.empty_like(emits), np.ones_like(emits), np.empty(len(rows.symbols), kind)
        for t, n in enumerate(rows.active):
            if t:
                now = forth @ alphas[:, rows.at(t - 1, n)]
            now *= emits[:, rows.at(t)]
            np.divide(now, np.add.reduce(now, 0, out=scale[rows.at(t)]), out=alphas[:, rows.at(t)])
        score += float(np.log(scale, dtype=float).sum())
        emits /= scale
        for i, j in enumerate(g):
            if cut.behind[j] is not None:
                end = rows.offset[rows.lengths[i] - 1] + i
                betas[:, end] = cut.behind[j] / (alphas[:, end] @ cut.behind[j])
        moves = np.zeros((k, k))
        for t in range(rows.steps - 1, 0, -1):
            n = rows.active[t]
            e = emits[:, rows.at(t)]
            e *= betas[:, rows.at(t)]
            moves += alphas[:, rows.at(t - 1, n)] @ e.T
            np.matmul(move, e, out=betas[:, rows.at(t - 1, n)])
        begins = np.ones(len(g), bool)
        begins[inner] = False
        moves += before @ (emits[:, inner] * betas[:, inner]).T
        alphas *= betas
        found.begin += alphas[:, rows.at(0)][:, begins].sum(1, dtype=float)
        found.move += moves
        for s in range(k):
            found.emit[:, s] += np.bincount(rows.symbols, alphas[s], m)
    found.move *= model.move
    return found, score


def updated(counts: Model, prior: np.ndarray) -> Model:
    """Next parameters; a little of the symbols' overall shares keeps every symbol possible in every state."""
    k = len(counts.begin)
    begin = counts.begin + 1.0
    move = counts.move + 1.0
    emit = counts.emit + 20.0 * prior[:, None]
    return Model(begin / begin.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0, keepdims=True))


def started(prior: np.ndarray, states: int, seed: int) -> Model:
    r = np.random.default_rng(seed)
    emit = prior[:, None] * r.gamma(2.0, 0.5, (len(prior), states))
    move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0, keepdims=True))


def gathered(lists: Iterable[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Longer lists: a recursion costs little more for many texts than for few."""
    out: list[np.ndarray] = []
    size = 0
    for texts in lists:
        out += texts
        size += sum(map(len, texts))
        if len(out) >= TEXTS or size >= TOKENS:
            yield out
            out, size = [], 0
    if out:
        yield out


class Lexicon:
    """Symbols and counts of words. head: word, count by falling count; its first ones are symbols, and the symbol 0 is
    the end."""

    def __init__(self, head: list[tuple[bytes, int]], symbols: int, buckets: int):
        self.first = 1 + min(symbols, len(head))
        self.buckets = buckets
        self.size = self.first + buckets
        self.rank = {w: i for i, (w, _) in enumerate(head)}
        self.symbol = np.array([i + 1 if i + 1 < self.first else self.bucket(w) for i, (w, _) in enumerate(head)] + [0], np.int32)
        self.log = np.log10(np.array([n for _, n in head] + [0], float) + 1.0)

    def bucket(self, word: bytes) -> int:
        return self.first + zlib.crc32(word) % self.buckets

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Places in the head; -1 for words beyond it."""
        return np.fromiter(map(self.rank.get, words, repeat(-1)), np.int32, len(words))

    def looked_up(self, ranks: np.ndarray, tail: list[bytes], beyond: np.ndarray) -> np.ndarray:
        """Symbols of words by their places in the head; tail: the words beyond it, at the indices `beyond`."""
        out = self.symbol[ranks]
        out[beyond] = self.first + np.fromiter(map(zlib.crc32, tail), np.int64, len(tail)) % self.buckets
        return out

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """Symbols of a text's words and its end."""
        ranks = self.ranks(words)
        beyond = np.flatnonzero(ranks < 0)
        return np.append(self.looked_up(ranks, [words[i] for i in beyond], beyond), np.int32(0))


def _head(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most `most`: those over a count that so many at most reach, found from a few hundred
    classes of counts, so that no task's own head goes to the driver."""
    scale = 32.0
    level = F.floor(F.log2("n") * scale)
    classes = sorted(((r.c, r.n) for r in counts.groupBy(level.alias("c")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for c, n in classes:
        if (total := total + n) > most:
            break
        least = c
    if least is None:
        return []
    found = [(bytes(w), n) for w, n in counts.filter(level >= least).collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def score_texts(
    docs: DataFrame, modulus: int = 7, held: int = 2, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD, symbols: int = SYMBOLS, buckets: int = BUCKETS, seed: int = 11, whole: int = WHOLE, shares: int = SHARES
) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(slot(modulus) == held, F.lit(False)).alias("held_out"), utf8().alias("text"))
    train = rows.filter(~F.col("held_out"))
    counts = saved(counted(train.select("text"), spaced), "words")
    n_words, v_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_texts = train.select("doc_id").count()
    n_all, v_all = n_words + n_texts, v_words + (n_texts > 0)
    top = _head(counts.filter(F.octet_length("word") <= 64), head)
    lexicon = Lexicon(top, symbols, buckets)
    per_bucket = np.zeros((buckets, 2))
    for b, n, v in counts.groupBy((F.crc32("word") % buckets).alias("b")).agg(F.sum("n"), F.count("*")).collect():
        per_bucket[b] = n, v
    for w, n in top[: lexicon.first - 1]:
        per_bucket[zlib.crc32(w) % buckets] -= n, 1
    prior = np.concatenate([[n_texts], [n for _, n in top[: lexicon.first - 1]], per_bucket[:, 0]]) + 0.5
    prior /= prior.sum()

    log_share = np.zeros(lexicon.size)
    log_share[lexicon.first :] = np.log10(per_bucket.sum(1) + 1.0)
    sent = spark.sparkContext.broadcast((lexicon, log_share))
    kind = np.dtype("<u2" if lexicon.size <= 1 << 16 else "<u4")

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        lexicon, log_share = sent.value
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
        for b in batches:
            # a batch's words are looked up together; its texts are stretches of them
            texts = [spaced(t.as_py()) for t in b.column(2)]
            words = [*chain.from_iterable(texts)]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            at = np.concatenate([[0], np.cumsum(sizes)])
            ranks = lexicon.ranks(words)
            beyond = np.flatnonzero(ranks < 0)
            tail = [words[i] for i in beyond]
            symbols = lexicon.looked_up(ranks, tail, beyond)
            own = np.where(symbols >= lexicon.first, lexicon.log[ranks], 0.0) - log_share[symbols]
            own[beyond] = -log_share[symbols[beyond]]
            ends = np.searchsorted(beyond, at)
            counted_ = [Counter(tail[x:y]) for x, y in zip(ends, ends[1:], strict=False)]
            total = lambda x, at=at: np.diff(np.concatenate([[0.0], np.cumsum(x)])[at])
            cells = np.insert(symbols, at[1:], 0).astype(kind)  # each text ends in the end's symbol, 0
            bounds = at + np.arange(len(at))
            out = [sizes + 1, sizes - np.diff(ends), total(lexicon.log[ranks]), total(own), [[*c.keys()] for c in counted_], [[*c.values()] for c in counted_], [cells[x:y].tobytes() for x, y in zip(bounds, bounds[1:], strict=False)]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["doc_id", "held_out", "n_tokens", "known", "logs", "own", "tail", "times", "symbols"])

    lexed = rows.mapInArrow(read, "doc_id long, held_out boolean, n_tokens long, known long, logs double, own double, tail array<binary>, times array<int>, symbols binary")
    share = F.when(~F.col("held_out"), F.pmod(F.xxhash64("doc_id", "symbols"), F.lit(shares))).cast("int")
    lexed = lexed.withColumn("row", F.monotonically_increasing_id()).withColumn("share", share).sortWithinPartitions("share")
    # small row groups in the order of shares: a round over one share reads little else
    lexed = saved(lexed, "symbols", **{"parquet.block.size": 2 << 20})
    model = started(prior, states, seed)
    for r in range(rounds if n_texts else 0):
        own = F.col("share").isNotNull() if r >= rounds - whole else F.col("share") == r % shares
        now = spark.sparkContext.broadcast(model)

        def step(batches: Iterator, now=now) -> Iterator[np.ndarray]:
            total = None
            for texts in gathered([np.frombuffer(t.as_py(), kind) for t in b.column(0)] for b in batches):
                got = expected(now.value, texts)[0].packed()
                total = got if total is None else total + got
            if total is not None:
                yield total

        if (summed := tree_sum(lexed.filter(own).select("symbols"), step)) is not None:
            model = updated(Model.unpacked(summed, states), prior)

    final = spark.sparkContext.broadcast(model)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        waiting: list = []

        def symbols() -> Iterator[list[np.ndarray]]:
            for b in batches:
                waiting.append(b.columns[:-1])
                yield [np.frombuffer(t.as_py(), kind) for t in b.columns[-1]]

        for texts in gathered(symbols()):
            hmm = likelihoods(final.value, texts) / np.log(10.0)
            at = 0
            for columns in waiting:
                n = len(columns[0])
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hmm[at : at + n])], ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "own", "hmm"])
                at += n
            waiting.clear()

    scored = lexed.select("row", "doc_id", "held_out", "n_tokens", "known", "logs", "own", "symbols").mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, own double, hmm double")
    tail = lexed.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    joined = tail.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    out = scored.join(joined, "row", "left").na.fill(0, ["more", "more_logs"])
    end_known, end_log = int(n_texts > 0), float(np.log10(n_texts + 1.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("more") + end_known).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more_logs") + end_log - F.col("n_tokens") * float(np.log10(n_all + v_all + 1.0))).alias("base_score"),
        (F.col("hmm") + F.col("own") + F.col("more_logs")).alias("score"),
    )
