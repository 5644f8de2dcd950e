"""Map, image and name tables derived from the star-schema tables, in SQL that Spark and DuckDB read alike.

A text may name tables and other inputs in braces. spark_table() builds the plan; oracle_text() gives one SQL text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.scratch import tasks

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

INPUTS = {
    # vector maps
    "colors": """select cast(n_regionkey as bigint) as map_id, cast((n_nationkey - n_regionkey) / 5 as int) as priority, n_name as name,
        cast((n_nationkey * 37) % 101 as double) / 100 as c, cast((n_nationkey * 53) % 101 as double) / 100 as m,
        cast((n_nationkey * 71) % 101 as double) / 100 as y, cast((n_nationkey * 29) % 51 as double) / 100 as k from {nation}""",
    "symbols": """select p_partkey % 5 as map_id, p_partkey as seq, cast(p_partkey % 193 as int) as file_id,
        case p_size % 5 when 0 then 1 when 1 then 2 when 2 then 4 when 3 then 8 else 16 end as symbol_type,
        concat(cast(p_size as varchar(10)), '.0', cast(p_partkey % 7 as varchar(10)), case when p_partkey % 3 = 0 then '.x' else '' end) as code, p_name as name,
        p_size % 11 = 0 as is_hidden, p_size % 13 = 0 as is_helper, p_size % 2 = 0 as is_rotatable,
        p_size % 7 * 100 as inner_radius, p_size % 6 - 1 as inner_color, p_size % 4 * 50 as outer_width, p_size % 9 - 2 as outer_color,
        p_size % 3 as elements, p_size % 5 * 40 as border_width, p_size % 8 - 1 as border_color, p_size % 10 * 250 as minimum_length
        from {part}""",
    "parts": """select s.map_id, s.seq as parent, j.i as part_seq, cast(s.file_id + 1 + (s.seq * 7 + j.i * 31) % 60 as int) as part_id, (s.seq + j.i) % 5 = 0 as is_private
        from {symbols} s cross join (select i from {numbers} where i < 3) j where s.symbol_type = 16""",
    "objects": """select l_partkey % 5 as map_id, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey % 100 * 100 + l_suppkey % 100 as object_seq,
        cast(l_suppkey % 220 - 5 as int) as symbol_id, l_quantity as quantity, l_partkey, l_suppkey, l_orderkey, l_linenumber from {lineitem}""",
    "renderables": """select l_suppkey % 20 as map_id, row_number() over (partition by l_suppkey % 20 order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as seq,
        case when l_linenumber = 7 then -900 else cast(l_quantity as int) % 9 - 1 end as color, cast(l_linenumber % 3 * 5 as int) as pen_width,
        l_partkey % 4 = 0 as is_empty, l_suppkey % 6 = 0 as clipped,
        cast(l_partkey % 2000 as double) as x, cast(l_orderkey % 1500 as double) as y, cast(l_linenumber % 4 as double) as w, cast(l_partkey % 3 as double) as h from {lineitem}""",
    "points": """select user_id as line, row_number() over (partition by user_id order by ts, event_id) as i, event_id * 7919 % 10007 as x,
        cast(floor(value * 100) as bigint) as y, case event_type when 'purchase' then 16 when 'signup' then 32 when 'error' then 4 else 0 end as flags from {events}""",
    "straight": """select o_custkey as line, row_number() over (partition by o_custkey order by o_orderkey) as i, cast(row_number() over (partition by o_custkey order by o_orderkey) * 3000 as bigint) as x,
        cast(0 as bigint) as y, case when o_orderkey % 3 = 0 then 32 else 0 end as flags from {orders}""",
    "squares": """select p_partkey as shape, p_partkey % 900 as cx, p_size * 17 as cy, p_size % 9 + 2 as half, p_partkey % 4 as kind from {part}""",
    # images: cells of 8 x 8 pixels, coloured by sums over lineitem
    "cells": """select l_suppkey as image, l_orderkey % 4 as cy, l_partkey % 4 as cx, cast(sum(l_quantity) as bigint) as s from {lineitem} group by l_suppkey, l_orderkey % 4, l_partkey % 4""",
    "sizes": "select distinct image, 33 as right_w, 32 + cast(image % 2 as int) as right_h from {cells}",
    "grid": "select a.i as y, b.i as x from (select i from {numbers} where i < 34) a cross join (select i from {numbers} where i < 34) b",
    "left_pixels": """select c.image, g.y, g.x, c.s * 37 % 256 as r, c.s * 111 % 256 as g, c.s * 59 % 256 as b from {cells} c join {grid} g
        on c.cy = cast(floor(g.y / 8) as bigint) and c.cx = cast(floor(g.x / 8) as bigint) and g.y < 32 and g.x < 32""",
    "right_pixels": """select z.image, g.y, g.x,
        case when g.y >= 32 or g.x >= 32 then 255 when c.s is null then 255 when c.s % 5 = 0 then least(255, c.s * 37 % 256 + 60) when g.x % 8 = 0 then least(255, c.s * 37 % 256 + 20) when g.x % 8 = 4 then least(255, c.s * 37 % 256 + 1) else c.s * 37 % 256 end as r,
        case when g.y >= 32 or g.x >= 32 or c.s is null then 255 when (g.x - 12) * (g.x - 12) + (g.y - 13) * (g.y - 13) < z.image % 20 then 0 else c.s * 111 % 256 end as g,
        case when g.y >= 32 or g.x >= 32 or c.s is null then 255 else c.s * 59 % 256 end as b
        from {sizes} z join {grid} g on g.x < z.right_w and g.y < z.right_h
        left join {cells} c on c.image = z.image and c.cy = cast(floor(g.y / 8) as bigint) and c.cx = cast(floor(g.x / 8) as bigint)""",
    # archives
    "files": """select p_brand as archive, p_partkey,
        concat(case p_partkey % 6 when 0 then lpad(cast(p_partkey % 50 as varchar(10)), 3, '0') when 1 then cast(p_partkey % 50 as varchar(10)) when 2 then '' when 3 then lpad(cast(p_partkey % 50 as varchar(10)), 2, '0') when 4 then lpad(cast(p_size as varchar(10)), 3, '0') else '007' end,
               case p_size % 4 when 0 then '__' when 1 then '_' when 2 then ' - ' else '' end, p_name, case when p_partkey % 5 = 0 then cast(p_partkey as varchar(10)) else '' end) as stem,
        case when p_size % 2 = 0 then '.omap' else '.xmap' end as suffix, p_partkey % 7 <> 0 as has_image from {part}""",
    "map_names": "select distinct archive, concat(stem, suffix) as name from {files}",
    "image_names": "select distinct archive, case when p_partkey % 11 = 0 then concat('x', stem, '.png') else concat(stem, '.png') end as name from {files} where has_image",
}


#: Inputs that pixels are made of, and what they are dealt out by: a few rows of them would share one task with all the
#: pixels that they become. The keys are those of the join that follows, so it takes as many partitions.
DEALT = {"cells": ("image", "cy", "cx"), "sizes": ("image",)}
#: Pixels of an image's two pictures at most.
PIXELS = 2 * 34 * 34


def spark_table(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """made: inputs that are there already; new ones are added."""
    made = {} if made is None else made
    if name not in made:
        if name == "numbers":
            made[name] = spark.range(1024).withColumnRenamed("id", "i")
        elif name in TABLES:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            df = spark_sql(spark, sf_dir, INPUTS[name], made)
            if name in DEALT:
                parts = _pixel_tasks(spark, sf_dir, made)
                df = df.repartition(parts, *DEALT[name])
                df.parts = parts
            made[name] = df
    return made[name]


def _pixel_tasks(spark: SparkSession, sf_dir: str, made: dict[str, DataFrame]) -> int:
    if "cells" in made:
        return made["cells"].parts
    images = spark_sql(spark, sf_dir, "select count(distinct l_suppkey) as n from {lineitem}", made).head()["n"]
    return tasks(spark, images * PIXELS)


def spark_sql(spark: SparkSession, sf_dir: str, text: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    made = {} if made is None else made
    return spark.sql(text, **{n: spark_table(spark, sf_dir, n, made) for n in set(re.findall(r"\{(\w+)\}", text))})


def oracle_text(text: str) -> str:
    """The text with inputs as subqueries."""
    while names := set(re.findall(r"\{(\w+)\}", text)):
        for n in names:
            inner = "(select range as i from range(1024))" if n == "numbers" else n if n in TABLES else f"({INPUTS[n]})"
            text = text.replace(f"{{{n}}}", inner)
    return text
