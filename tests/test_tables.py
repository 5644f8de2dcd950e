"""Relational operators against plain versions, at depths and lengths that queries over the test tables don't reach."""

import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import maps
from tests.conftest import ROOT


@pytest.mark.parametrize("left", [[], ["corpus_pipeline.py"], ["tessera/llm/__pycache__"]])
def test_the_rest_works_without_the_optional_subpackage(tmp_path, left):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    for name in left:
        (copy / name).mkdir(parents=True) if name.endswith("__") else (copy / name).write_text("import tessera.llm.bpe\n")
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 70 and set(o) <= set(q) and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)


def test_coordinates_equal_the_file_readers(spark):
    from tessera.sources.xmap import coordinates

    texts = ["500 -250;7000 0 1;61 45;500 -250 18;", "1 2 x;3 4\n 1 ; 5 6.5;7 8", ";1 2", " ; 1 2", "1 2 3 4 5 6", "1 2 3 4", "5;6 7", "", " ", "1 2;;;3 4", "99999999999 1;2 3", "1 2 99999999999;2 3", "+1 -2 +3", "1 2 -3;1 2 +-3 4 5;", "1　2 3;4 5 5", "1 2 3;9999999999 1;2 3", None, "12 34 2;" * 100_000, "a b"]
    df = spark.createDataFrame([*enumerate(texts)], "x int, t string")
    for r in T.with_coordinates(df, "t", "found").collect():
        want = r.t if r.t is None else [(round(x * 1000), round(y * 1000), f) for x, y, f in coordinates(r.t)]
        assert r.found == want if want is None else [tuple(c) for c in r.found] == want


def _parts(spark):
    rows = [(1, i, 0, i + 1) for i in range(200)] + [(2, 0, 0, 1), (2, 1, 0, 2), (2, 2, 0, 0), (2, 2, 1, 3), (2, 3, 0, 3), (2, 0, 1, 3), (3, 5, 0, None)]
    return rows, spark.createDataFrame(rows, "map_id int, parent long, part_seq int, part long")


def test_closure_of_chains_and_cycles(spark):
    rows, parts = _parts(spark)
    tops = [(1, 0), (1, 150), (2, 0), (2, 3), (3, 5), (4, 7)]
    want = set()
    for m, top in tops:
        todo = [top]
        while todo:
            s = todo.pop()
            if (m, top, s) not in want:
                want.add((m, top, s))
                todo += [p for a, b, _, p in rows if (a, b) == (m, s) and p is not None]
    got = [tuple(r) for r in maps.closure(spark.createDataFrame(tops, "map_id int, seq long"), parts).select("map_id", "root", "seq").collect()]
    assert len(got) == len(want) and set(got) == want


def test_ways_down_chains_and_cycles(spark):
    rows, parts = _parts(spark)

    def below(m, through, path):
        yield (m, through[0], through[-1], path, len(path))
        for a, b, i, p in rows:
            if (a, b) == (m, through[-1]) and p is not None and p not in through:
                yield from below(m, (*through, p), (*path, i))

    tops = [(1, 190), (2, 0), (2, 2), (3, 5)]
    got = [(r.map_id, r.root, r.seq, tuple(r.path), r.level) for r in maps.part_tree(spark.createDataFrame([*tops, (1, 0)], "map_id int, seq long"), parts).collect()]
    assert sorted(g for g in got if g[1:2] != (0,) or g[0] == 2) == sorted(w for m, s in tops for w in below(m, (s,), ()))
    assert sorted(g[4] for g in got if g[:2] == (1, 0)) == [*range(201)]


def test_lengths_of_long_lines_and_of_single_points(spark, tmp_path):
    """Lines of 50,000, two and one points, and points without a place, against the query's SQL."""
    import duckdb

    import __spark_entry__

    at = f"{tmp_path}/events.parquet"
    lines = [(1, 50_000), (2, 2), (3, 1), (4, 3)]
    duckdb.sql("copy (select row_number() over () as event_id, timestamp '2024-01-01' as ts, line as user_id, 'view' as event_type, case when line = 4 and i = 1 then null else i * 37 % 1000 / 3.0 end as value from (values " + ", ".join(map(str, lines)) + f") v(line, n) cross join range(50000) r(i) where i < n) to '{at}' (format parquet)")
    connection = duckdb.connect()
    connection.execute(f"create view events as select * from '{at}'")
    got = __spark_entry__.queries()["path_length"](spark, str(tmp_path)).select("line", "hundreds").collect()
    want = connection.execute(f"select line, hundreds from ({__spark_entry__.oracle_sql()['path_length']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 4


def test_points_in_rings_are_compiled_and_spread(spark):
    import __spark_entry__
    from tests.conftest import DATA

    for name in ("point_in_path", "placement_modes"):
        plan = __spark_entry__.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert not any(f"{f}(" in plan for f in ("aggregate", "zip_with", "transform", "forall", "exists")), name
    assert __spark_entry__.queries()["point_in_path"](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_points_in_a_ring_with_a_notch(spark):
    """Against rays counted edge by edge, beside corners and on edges too."""
    from tessera.functions import math as M

    ring = [(0, 0), (8, 0), (8, 8), (4, 3), (0, 8)]
    points = [(x / 2, y / 2) for x in range(-2, 19) for y in range(-2, 19)]
    want = [sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1 for x, y in points]
    corners = [M.point(F.lit(x), F.lit(y)) for x, y in ring]
    df = spark.createDataFrame(points, "x double, y double")
    assert [r.i for r in df.select(maps.inside_polygon(corners, F.struct("x", "y")).alias("i")).collect()] == want
