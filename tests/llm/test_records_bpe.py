import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chunks, records
from tessera.llm.common import scratch
from tessera.llm.queries import queries, vocabulary

ODD = ["<|endoftext|>a <|endoftext|> b", " a", "a ", "a  b", "a\n b", "a \nb", "don't! I'll, x.", "é. ß, 1. 2, a1.", " x  ", "", "   ", "a　 b. ", "x...y ...", "a.\nB, c\n\nd", "\x1c\x1d a\x1fb", "ΣΑΣ. ΟΔΟΣ,", "ＡＢ１２", "🙂🙂 ok!!", "éa ́b"]


@pytest.fixture(scope="module")
def bytes_path():
    return vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def words_path():
    return vocabulary("word_bpe_49k.json")


def test_byte_level_pieces_equal_the_library(bytes_path):
    e = chunks.ByteLevelEncoder(bytes_path, most=4)  # so small that it turns over all the time
    r = random.Random(3)
    texts = ODD + ["".join(r.choice("abc .,\n\t'1é ") for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u2").tolist() == e.library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 64])
def test_tree_concatenation_equals_the_library(words_path, leaf):
    e = bpe.TreeEncoder(words_path, leaf, most=4)
    r = random.Random(leaf)
    texts = ODD + ["a" * 1000, "thethethe" * 90, "é" * 200, "".join(r.choice("etaoinshr") for _ in range(2000)), "🙂" * 100]
    for t in texts:
        ids = e.library.encode(t, add_special_tokens=False).ids
        assert e.encode(t) == (len(ids), " ".join(map(str, ids)), e.library.decode(ids, skip_special_tokens=False)), t[:40]
        assert e.decode(ids) == e.library.decode(ids, skip_special_tokens=False)


def test_long_units_are_encoded_in_one_batch(words_path):
    e = bpe.TreeEncoder(words_path)
    t = "".join(random.Random(7).choice("etaoinshrdlu") for _ in range(3 * bpe.LEAF * bpe.THREADED))
    assert e.encode(t)[1] == " ".join(map(str, e.library.encode(t, add_special_tokens=False).ids)) and e.joins > bpe.THREADED


def test_other_pre_tokenizers_get_whole_texts(words_path, tmp_path):
    import json

    shape = json.load(open(words_path)) | {"pre_tokenizer": None, "added_tokens": []}
    (tmp_path / "t.json").write_text(json.dumps(shape))
    e = bpe.TreeEncoder(str(tmp_path / "t.json"))
    assert not e.spaces and bpe.TreeEncoder(words_path).spaces


def test_an_id_that_repeats_fills_no_shard(spark, bytes_path):
    at = scratch(spark, "test")
    docs = spark.range(4000).selectExpr("case when id % 2 = 0 then 7 else id end as doc_id", "'one text of some words' as text")
    records.write_records(docs, at, bytes_path, shards=8)
    got = records.read_index(spark, at).groupBy("shard").count().collect()
    assert len(got) == 8 and max(r["count"] for r in got) < 1000
    index = records.read_index(spark, at).orderBy("start").select("doc_id").collect()
    assert [r.doc_id for r in index] == sorted(r.doc_id for r in index) and len(index) == 4000


def test_frames_are_checked():
    ids = np.array([1, 2, 70_000], "<u4").tobytes()
    data = records.frame(7, ids, 4) + b"\n" + records.frame(None, b"", 2) + b"\n"
    doc, got, at = records.unframe(data)
    assert (doc, got.tolist()) == (7, [1, 2, 70_000])
    assert records.unframe(data, at)[0] is None
    for i in (2, 9, 20, 30):
        with pytest.raises(ValueError):
            records.unframe(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
    with pytest.raises(ValueError):
        records.unframe(data[:15])


def test_op1_whole_table(spark, data, bytes_path):
    got = {r.doc_id: r for r in queries()["op1_token_records"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    library, start = chunks.load(bytes_path), 0
    for d in docs:
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 0]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_records_of_odd_rows_and_in_shuffled_order(spark, odd_docs, no_docs, bytes_path):
    at = scratch(spark, "test")
    records.write_records(odd_docs, at, bytes_path, shards=3)
    index = records.read_index(spark, at).orderBy(F.asc_nulls_first("doc_id"), "start").collect()
    assert len(index) == odd_docs.count()
    assert [r.start for r in index] == np.cumsum([0, *[r.n_tokens for r in index]])[:-1].tolist()
    first, second = ([(r.doc_id, r.ids) for r in records.read_shuffled(spark, at, seed).collect()] for seed in (1, 2))
    assert sorted(first, key=repr) == sorted(second, key=repr) and first != second
    assert sorted(len(i) for _, i in first) == sorted(r.n_tokens for r in index)
    empty = scratch(spark, "test")
    records.write_records(no_docs, empty, bytes_path)
    assert records.read_index(spark, empty).count() == 0


def test_op3_whole_table(spark, data, words_path):
    library = chunks.load(words_path)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {d.doc_id: d.text or "" for d in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries()["op3_bpe"](spark, data).collect()
    tree = bpe.TreeEncoder(words_path)
    assert all(tree.encode(t)[0] >= 0 for t in texts.values()) and tree.joins > 100  # words of the tables reach the tree
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_bpe_of_odd_rows(spark, odd_docs, no_docs, words_path):
    got = bpe.encode_decode(odd_docs, words_path, ["doc_id", "text", "score"], with_ids=True).collect()
    library = chunks.load(words_path)
    assert len(got) == odd_docs.count()
    for r in got:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.score == 1
    assert bpe.encode_decode(no_docs, words_path).count() == 0
