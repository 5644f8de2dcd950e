"""Connected components of a large edge table, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, saved


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component (the smallest id reachable) for each end of edges(a long, b long). Loops and repeated edges do no
    harm; an empty table gives no rows. Each round's edges are written, so a lost executor costs one round at most."""
    now = saved(_falling(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        large = saved(_falling(_large_star(now)), "star")
        after = saved(_falling(_small_star(large)), "star")
        drop(now.sparkSession, large.scratch_path)
        drop(now.sparkSession, now.scratch_path)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)


def _falling(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex moves to the vertex's smallest one."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
