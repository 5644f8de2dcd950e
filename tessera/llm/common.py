"""What the operators of this subpackage share: session settings, scratch tables, text columns and tree sums."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.scratch import drop, saved, scratch, shared_dir  # noqa: F401  (for the operators)

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Rows and bytes of text in one Arrow batch: what a Python worker holds at once.
BATCH_ROWS = 512
BATCH_BYTES = 32 << 20


#: Malloc settings of Python workers: freed memory goes back to the system instead of staying with a worker. Arrow's own
#: pool is left alone: with the system's, its conversion to pandas crashed.
_MEMORY = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_MMAP_THRESHOLD_": "262144"}
_held: dict = {}


def held(key: tuple, make: Callable):
    """What a Python worker keeps from task to task, such as a cache of words: one thing at a time, so that several
    operators in a row don't add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches, where the session allows larger ones, and let Python workers import this library from where the driver has it."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    for name, value in _MEMORY.items():
        env.setdefault(name, value)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if root not in sys.path:
        sys.path.append(root)


def _bytes(size: str) -> int:
    """A number of bytes as Spark's settings spell it."""
    number = "".join(c for c in size if c.isdigit() or c == "-")
    unit = size.strip().lower().removeprefix(number).removesuffix("b")
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit] if int(number) >= 0 else 1 << 62


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str = "text") -> Column:
    """A text column as bytes, null as empty."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit(b""))


def marked(rows: DataFrame, key: Column, keys: DataFrame, most_bits: int = 24) -> DataFrame:
    """rows with __hit: whether the key may be among keys(k). A row without it surely isn't, so it needs no exchange to
    be told apart. A bitmap goes to the tasks, of 16 bits a key but 2**most_bits in all, 32 in a row of a broadcast
    join; with more keys than that it just tells less."""
    size = min(most_bits, max(16, (16 * keys.count()).bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << size))
    at = lambda p: (p % 32).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at(F.col("p")))
    bits = keys.select(bit(F.col("k")).alias("p")).groupBy(F.floor(F.col("p") / 32).alias("__word")).agg(F.bit_or(one).alias("__bits"))
    placed = rows.withColumn("__bit", bit(key)).withColumn("__word", F.floor(F.col("__bit") / 32))
    found = F.coalesce(F.call_function("shiftright", F.col("__bits"), at(F.col("__bit"))) % 2 == 1, F.lit(False))
    return placed.join(F.broadcast(bits), "__word", "left").select(*[quoted(c) for c in rows.columns], found.alias("__hit"))


def quoted(name: str) -> Column:
    """A column by its exact name, whatever it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def aside(docs: DataFrame) -> tuple[DataFrame, list[str], list[Column]]:
    """docs with every column but doc_id and text under a name of its own, so that none can clash with an operator's;
    the columns there, and the expressions that give them their old names back."""
    names = {c: c if c in ("doc_id", "text") else f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[quoted(c).alias(n) for c, n in names.items()]), [*names.values()], [F.col(n).alias(c) for c, n in names.items()]


def without(keep: list[str] | None, made: str) -> list[str]:
    """The columns to keep (doc_id where none are named) but those that the operator makes itself."""
    own = {c.lower() for c in made.split()}
    return [c for c in keep or ["doc_id"] if c.lower() not in own]


def texted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, and the text's bytes where the text isn't among them."""
    return docs.select(*[quoted(c) for c in keep], *([] if "text" in keep else [utf8().alias("__bytes")]))


def text_bytes(batch, keep: list[str]):
    """The texts of a batch of texted(), as bytes, null as empty."""
    import pyarrow as pa

    column = batch.column(keep.index("text") if "text" in keep else len(keep)).cast(pa.binary())
    return column.fill_null(b"") if column.null_count else column


def kept_schema(docs: DataFrame, keep: list[str], more: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return ", ".join([*(f"{'`' + c.replace('`', '``') + '`'} {kinds[c]}" for c in keep), more])


def slot(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, by which rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def tree_sum(df: DataFrame, step: Callable[[Iterator], Iterator[np.ndarray]]) -> np.ndarray | None:
    """Sum of one array per partition. step gets the partition's Arrow batches; partial sums meet in a tree of tasks,
    so the driver reads a few arrays however many partitions there are."""

    def packed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for x in step(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes()], pa.binary())], ["x"])

    parts = df.mapInArrow(packed, "x binary").rdd.map(lambda r: np.frombuffer(r[0], "<f8"))
    n = parts.getNumPartitions()
    return parts.treeAggregate(None, _plus, _plus, depth=max(2, int(np.ceil(np.log(max(n, 2)) / np.log(32)))))


def _plus(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    return b if a is None else a if b is None else a + b
