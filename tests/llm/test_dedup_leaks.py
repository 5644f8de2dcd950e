import hashlib
import re
from itertools import combinations

import pytest

from tessera.llm import decontaminate, fingerprint, graph, neardup
from tessera.llm.queries import queries


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute_components(rows, width, percent):
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        n = min(width, len(words))
        sets.setdefault(doc_id, []).append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: root(d) for d in sets}, {d: len(s[0]) for d, s in sets.items()}


def test_op8_whole_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    found, sizes = brute_components(rows, 3, 85)
    got = queries()["op8_near_duplicates"](spark, data).collect()
    assert {r.doc_id: r.component_id for r in got} == found and len(got) == len(rows)
    assert all(r.n_shingles == sizes[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)
    assert any(not r.kept for r in got)


def test_chains_and_large_groups_lose_no_link(spark):
    """Families whose members are near their neighbours but not near all, one large group, and copies."""
    words = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(12):  # each step replaces one more word
        rows.append((k, " ".join(words[:k] + [f"n{i}" for i in range(0)] + words[k : k + 40])))
    for k in range(40):
        text = [f"g{i}" for i in range(80)]
        text[k % 80] = f"changed{k}"
        rows.append((100 + k, " ".join(text)))
    rows += [(200 + k, "same text again and again for ever") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((3, 85), (5, 80), (2, 90)):
        found, _ = brute_components(rows, width, percent)
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, width=width, percent=percent).collect()} == found


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None]
    found, _ = brute_components(rows, 3, 85)
    got = neardup.near_duplicates(odd_docs, width=3, percent=85).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r.component_id, r.kept) == ((found[r.doc_id], found[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True))
    assert neardup.near_duplicates(no_docs).count() == 0
    kept = neardup.one_of_each(odd_docs, width=3, percent=85).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(d for d, c in found.items() if d == c)
    assert sum(r.doc_id is None for r in kept) == 1


def test_odd_sketch_estimates(spark):
    import numpy as np

    signer = neardup.Signer(18, 4, 512, 1)
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    for share in (0.95, 0.85):
        other = base.copy()
        n = int(400 * (1 - share) / (1 + share))
        other[:n] = r.integers(0, 1 << 63, n, dtype=np.uint64)
        a, b = (signer.sketch(signer.samples(x)).tolist() for x in (base, other))
        df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
        assert abs(df.select(neardup.estimate(df.a, df.b, 72, 512)).first()[0] - share) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 103: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_leaks(text, items, width=8):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        n = min(width, len(w))
        for s in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == s:
                    hit.update(range(i, i + n))
                    found.add(item)
    ids = sorted(map(str, found))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids) >= 2


@pytest.mark.parametrize("most", [decontaminate.MOST_BYTES, 0])
def test_leaks_equal_brute_force(spark, most):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items = [(1, long), (2, "Short ITEM"), (3, None), (4, ""), (5, "x " * 9), (12, "short item again but longer than eight words are in all"), (2, "Short ITEM")]
    docs = [(1, f"before {long.upper()} after short item"), (2, "short, item! short item"), (3, None), (4, ""), (5, "x " * 30), (6, long[:40]), (7, "y"), (None, f"{long} {long}"), (1, "short item")]
    d = spark.createDataFrame([(a, b, 5) for a, b in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame([(a, t, "z") for a, t in items], "item_id long, text string, words string")
    got = decontaminate.decontaminate(d, b, most=most).collect()
    want = [(i, *brute_leaks(t, items)) for i, t in docs]
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got], key=repr) == sorted(want, key=repr)
    assert all(sum(y - x for x, y in r.spans) == r.n_hit and len(r.items) == r.n_items for r in got)
    assert decontaminate.decontaminate(d.limit(0), b, most=most).count() == 0
    assert not any(r.n_items for r in decontaminate.decontaminate(d, b.limit(0)).collect())


@pytest.mark.parametrize("keep", [["doc_id"], ["doc_id", "text"]])
def test_repeated_rows_stay_where_items_are_joined(spark, keep):
    items = [(i, f"item {'abcdefg'[i]} " * 6) for i in range(7)]
    docs = [(1, items[0][1]), (1, items[0][1]), (None, "no id"), (None, "no id"), (2, None), (2, ""), (3, f"{items[1][1]} {items[6][1]}"), (3, f"{items[1][1]} {items[6][1]}")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(d, b, keep=keep, most=0).collect()
    want = [((i, t)[: len(keep)], *brute_leaks(t, items)) for i, t in docs]
    assert sorted([(tuple(r[k] for k in keep), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got], key=repr) == sorted(want, key=repr)


def canonical(text):
    import unicodedata

    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    return " ".join(nfkc(nfkc(text or "").casefold()).split())


@pytest.mark.parametrize("weak", [False, True])
def test_fingerprints_equal_brute_force(spark, weak):
    from pyspark.sql import functions as F

    texts = ["Straße  Ｆull", "STRASSE full", "strasse\nfull ", "ﬁne print", "fine PRINT", None, "", "abcdefghijkl", "abcdefghijkl" * 400, "🙂🙂🙂🙂🙂é", "x", "abcdefghijkl"]
    docs = spark.createDataFrame([(3 * i + 1, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, next string")
    # a digest of two values alone makes every bucket hold several forms
    digest = (lambda c: (F.length(c) % 2).cast("string")) if weak else fingerprint.wide_digest
    got = sorted(fingerprint.fingerprints(docs, digest).collect())
    assert len(got) == len(texts)
    seen = {}
    for i, r in enumerate(got):
        t, n = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + n[:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(n)))
        for mark, form in ((r.fingerprint, canonical(t)), (r.edited_fingerprint, canonical(edited))):
            assert seen.setdefault(mark, form) == form
    assert len(set(seen.values())) == len(seen)


def test_fingerprints_of_odd_rows(spark, odd_docs, no_docs):
    got = fingerprint.fingerprints(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert len({r.fingerprint for r in got if r.doc_id == 4}) == 1
    assert fingerprint.fingerprints(no_docs).count() == 0
    one = fingerprint.fingerprints(odd_docs.filter("doc_id = 0")).first()
    assert one.near_next == 1.0
