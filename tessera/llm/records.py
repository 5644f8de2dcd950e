"""Token-ID / binary output: length-delimited records with masked checksums and a separate offset index.

A shard is a file of records. A record is

    length    8 bytes, little-endian: bytes of the payload
    check     4 bytes: masked crc32 of the 8 length bytes
    payload   1 byte of flags (1: there is an id, 2: token ids of 4 bytes, else 2), 8 bytes document id, the token ids
    check     4 bytes: masked crc32 of the payload
    end       one line feed

A checksum c is masked as rotate_right(c, 15) + 0xA282EAD8 modulo 2**32, so that a checksum over bytes that hold
checksums stays useful. Shards are written by Spark's own writer, so its commit protocol decides which task's file
counts when executors are lost, and any file system that Spark knows will do. Documents stand in ascending doc_id order
(nulls first, equal ids by a hash of their text), shard after shard; shards are made so many that each has a bounded
share of the text, however often an id repeats. The index is a Parquet table with a row for each record: shard,
offset, length and counts. A reader that wants records in a random order takes them from the index.

Empty and null texts give records with the end id alone; an empty table gives no records; repeated rows give a record
each. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.chunks import byte_level_encoder
from tessera.llm.common import tune, utf8

#: Bytes of text for a shard, whose file a reader holds whole, and index rows of one batch.
SHARD, ROWS = 256 << 20, 10_000
_HEAD, _PAYLOAD = struct.Struct("<QI"), struct.Struct("<Bq")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record without its end."""
    payload = _PAYLOAD.pack((doc_id is not None) | (width == 4) << 1, doc_id or 0) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """The document id and token ids of the record at an offset, and the next record's offset; ValueError if damaged."""
    if len(data) < at + _HEAD.size:
        raise ValueError(f"record at {at}: the shard is cut off")
    n, check = _HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"record at {at}: the length is damaged")
    end = (begin := at + _HEAD.size) + n
    if data[end + 4 : end + 5] != b"\n":
        raise ValueError(f"record at {at}: the record is cut off")
    if struct.unpack_from("<I", data, end)[0] != masked(data[begin:end]):
        raise ValueError(f"record at {at}: the payload is damaged")
    flags, doc_id = _PAYLOAD.unpack_from(data, begin)
    ids = np.frombuffer(data, "<u4" if flags & 2 else "<u2", (n - _PAYLOAD.size) // (4 if flags & 2 else 2), begin + _PAYLOAD.size)
    return (doc_id if flags & 1 else None), ids, end + 5


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, shards: int | None = None) -> None:
    """Encode docs(doc_id, text), append end_id to each, write the shards under path + "/shards" and then the index
    under path + "/index". shards: their number, else as many as the text needs for SHARD bytes each, and at least the
    session's number of shuffle partitions."""
    spark = docs.sparkSession
    tune(spark)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), _bytes_of(docs) // SHARD + 1)

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = byte_level_encoder(vocabulary)
        end = encoder.pack([end_id])
        for b in batches:
            ids = map(encoder.encode, b.column(1).cast(pa.string()).to_pylist())
            out = [frame(i, x + end, encoder.width) for i, x in zip(b.column(0).to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    # rows that repeat an id are dealt by their texts' hashes too, and equal ones by their place, so no id fills a shard
    spread = [F.col("doc_id"), F.xxhash64("text"), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))]
    ordered = rows.repartitionByRange(shards, *spread).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    records = ordered.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\n").option("compression", "none").text(f"{path}/shards")
    _index(spark, path).write.parquet(f"{path}/index")


def _bytes_of(docs: DataFrame) -> int:
    """About the bytes of docs' texts, by what Spark knows of its files, which are compressed by a factor of 4 at most as
    a rule. Only of tables that it knows nothing of are the texts' lengths added up."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 4 * size if size < 1 << 50 else docs.agg(F.coalesce(F.sum(F.octet_length(utf8())), F.lit(0))).first()[0]


def _index(spark: SparkSession, path: str) -> DataFrame:
    """Read every shard, check every record; a row for each."""

    def batch(rows: list[tuple]):
        import pyarrow as pa

        kinds = [pa.string(), *[pa.int64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "offset", "length", "doc_id", "n_tokens", "shard_start", "ids_crc32"])

    def scan(batches: Iterator) -> Iterator:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data, at, start, out = data.as_py(), 0, 0, []
                while at < len(data):
                    doc_id, ids, after = unframe(data, at)
                    out.append((name, at, after - at, doc_id, len(ids), start, zlib.crc32(ids.astype("<u4").tobytes())))
                    at, start = after, start + len(ids)
                    if len(out) == ROWS:
                        yield batch(out)
                        out = []
                if out:
                    yield batch(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content").mapInArrow(scan, "shard string, offset long, length long, doc_id long, n_tokens long, shard_start long, ids_crc32 long")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index with `start`, the number of ids before the record in all shards. Shards are in the order of the numbers
    in their names; only one row a shard meets in the window."""
    index = spark.read.parquet(f"{path}/index")
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    number = F.regexp_extract("shard", r"part-([0-9]+)", 1).cast("long")
    before = totals.select("shard", (F.sum("total").over(Window.orderBy(number)) - F.col("total")).alias("before"))
    return index.join(before, "shard").withColumn("start", F.col("before") + F.col("shard_start")).drop("before")


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All records, position(long), doc_id, ids array<int>, dealt in an order that depends on the seed alone: the index
    is sorted by a seeded hash and each row's bytes are cut out of its shard by offset and length."""
    tune(spark)
    schema = "key long, shard string, offset long, doc_id long, ids array<int>"

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for name, wanted, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = data.as_py()
                got = [(w["key"], name, w["offset"], *unframe(data, w["offset"])[:2]) for w in wanted]
                yield pa.RecordBatch.from_pylist([{"key": k, "shard": s, "offset": o, "doc_id": d, "ids": i.tolist()} for k, s, o, d, i in got], pa.schema([("key", pa.int64()), ("shard", pa.string()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    key = F.xxhash64(F.lit(seed), "shard", "offset").alias("key")
    wanted = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.collect_list(F.struct(key, "offset")).alias("wanted"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")
    return wanted.join(files, "shard").select("shard", "wanted", "content").mapInArrow(cut, schema).orderBy("key", "shard", "offset").select("doc_id", "ids")
