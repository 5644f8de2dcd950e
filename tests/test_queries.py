"""Every query against its oracle SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        connection.execute(f"create view {t} as select * from '{path}/*.parquet'" if os.path.isdir(path) else f"create view {t} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    found = duck.sql(ORACLES[name])
    assert columns == sorted(found.columns)
    want = sorted(repr(tuple(dict(zip(found.columns, r, strict=True))[c] for c in columns)) for r in found.fetchall())
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_worst_regions_equal_a_plain_choice(spark):
    """Pixel by pixel: the worst 16 x 16 block's surroundings, then the worst of those no region touches, until none is left."""
    q, found = __spark_entry__.queries(), {}
    real, size = {}, {}
    for r in q["image_pixel_mask"](spark, DATA).collect():
        w, h = size.get(r.image, (0, 0))
        size[r.image] = max(w, r.x + 1), max(h, r.y + 1)
        if r["class"] == 2:
            real.setdefault(r.image, []).append((r.x, r.y))
    for image, pixels in real.items():
        w, h = size[image]
        side, gone = min(16, w, h), set()
        while True:
            scores = {}
            for x, y in pixels:
                if (y // 16, x // 16) not in gone:
                    scores[y // 16, x // 16] = scores.get((y // 16, x // 16), 0) + 1
            if not scores:
                break
            by, bx = min(b for b, n in scores.items() if n == max(scores.values()))
            x0, y0 = min(max(bx * 16 + 8 - side // 2, 0), w - side), min(max(by * 16 + 8 - side // 2, 0), h - side)
            gone |= {(y // 16, x // 16) for y in range(y0, y0 + side) for x in range(x0, x0 + side)}
            rank = sum(k[0] == image for k in found) + 1
            found[image, rank] = (x0, y0, sum(x0 <= x < x0 + side and y0 <= y < y0 + side for x, y in pixels))
    got = {(r.image, r["rank"]): (r.x, r.y, r.real_px) for r in q["image_worst_regions"](spark, DATA).collect()}
    assert got == found and len(got) > 20


def test_every_image_is_magnified(spark):
    from tessera.plans.inputs import spark_table

    larger = DATA.replace("sf0.001", "sf0.01")
    pixels = spark_table(spark, larger, "left_pixels").collect()
    assert any(p.image >= 10 for p in pixels)
    want = sorted((p.image, p.y * 2 + dy, p.x * 2 + dx, p.r, p.g, p.b) for p in pixels for dy in (0, 1) for dx in (0, 1))
    got = __spark_entry__.queries()["image_magnify"](spark, larger).select("image", "y", "x", "r", "g", "b").collect()
    assert sorted(map(tuple, got)) == want


def test_every_line_has_its_next_dash_points(spark):
    q, larger = __spark_entry__.queries(), DATA.replace("sf0.001", "sf0.01")
    lines = {r.line for r in q["next_dash_point"](spark, larger).select("line").distinct().collect()}
    assert lines == {r.line for r in q["path_parts"](spark, larger).select("line").distinct().collect()} and max(lines) >= 20


def test_every_map_is_looked_up(spark):
    got = __spark_entry__.queries()["color_lookup"](spark, DATA).collect()
    assert {r.map_id for r in got} == set(range(5)) == {r.map_id for r in got if r.color == -900}


def test_a_task_takes_no_more_pixels_where_there_are_more_images(spark, monkeypatch):
    from tessera import scratch

    monkeypatch.setattr(scratch, "ROWS", 20_000, raising=False)
    q, larger = __spark_entry__.queries(), DATA.replace("sf0.001", "sf0.01")
    sizes = [len(p) for p in q["image_pixel_mask"](spark, larger).rdd.glom().collect()]
    assert sum(sizes) > 100_000 and max(sizes) <= 20_000


def test_regions_meet_pixels_by_blocks(spark):
    """Squares across blocks, one without differences, and an image lower than a block, against plain counts."""
    from tessera.operators import diff

    places = [(1, x, y) for x in range(0, 60, 3) for y in range(0, 60, 7)] + [(2, x, 3) for x in range(0, 80, 5)]
    squares = [(1, 10, 10, 16, 1), (1, 16, 16, 16, 2), (1, 1, 1, 2, 3), (1, 40, 0, 33, 4), (2, 3, 0, 9, 1), (2, 64, 0, 9, 2)]
    pixels = spark.createDataFrame([(*p, 2) for p in places] + [(1, 11, 11, 1)], "image long, x long, y long, class int")
    got = diff.count_in(pixels, spark.createDataFrame(squares, "image long, x long, y long, size long, rank int")).collect()
    want = {(i, x, y, s, k): sum(j == i and x <= a < x + s and y <= b < y + s for j, a, b in places) for i, x, y, s, k in squares}
    assert {(r.image, r.sx, r.sy, r["size"], r["rank"]): r.real_px for r in got} == want and min(want.values()) == 0


def test_regions_are_chosen_in_as_many_tasks_as_pixels_need(spark):
    plan = __spark_entry__.queries()["image_worst_regions"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapGroupsInPandas") :]
    assert plan.count("FlatMapGroupsInPandas") == 1 and "REPARTITION_BY_NUM" in below[: below.index("Join")]
