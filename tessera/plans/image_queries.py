"""Queries of image comparison over derived image pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import diff
from tessera.plans.registry import Inputs, query
from tessera.scratch import saved

# The oracle pairs pixels first and takes plain 3 x 3 neighbourhoods by a self-join of rows and columns.
_PAIRS = """p as (select coalesce(l.image, r.image) as image, coalesce(l.y, r.y) as y, coalesce(l.x, r.x) as x, l.r as r0, l.g as g0, l.b as b0, r.r as r1, r.g as g1, r.b as b1
  from {left_pixels} l full join {right_pixels} r on l.image = r.image and l.y = r.y and l.x = r.x),
s as (select * from p where r0 is not null and r1 is not null),
w as (select image, y, x, """ + ", ".join(f"min({c}{i}) over a as l{c}{i}, max({c}{i}) over a as h{c}{i}" for i in (0, 1) for c in "rgb") + """ from s window a as (partition by image, y order by x rows between 1 preceding and 1 following)),
v as (select image, y, x, """ + ", ".join("+".join(f"max(h{c}{i}) over a - min(l{c}{i}) over a" for c in "rgb") + f" as e{i}" for i in (0, 1)) + """ from w window a as (partition by image, x order by y rows between 1 preceding and 1 following)),
m as (select p.image, p.y, p.x, abs(r0 - r1) + abs(g0 - g1) + abs(b0 - b1) as d, e0, e1 from p left join v on v.image = p.image and v.y = p.y and v.x = p.x),
k as (select image, y, x, case when d is null then 2 when d <= 3 then 0 when e0 > 3 and e1 > 3 then 1 else 2 end as class, d as distance from m)"""
_MASK = "with " + _PAIRS


def _mask(t: Inputs) -> DataFrame:
    return diff.mask(t.left_pixels, t.right_pixels, parts=t.cells.parts)


_SUMMARY = """u as (select image, (max(x) + 1) * (max(y) + 1) as size, count(*) filter (class = 1) as n_aa, count(*) filter (class = 2) as n_real, coalesce(max(distance), 0) as largest,
  count(*) filter (distance > 3) as n, sum(distance) filter (distance > 3) as s, sum(distance * distance) filter (distance > 3) as q from k group by image)"""


@query(_MASK + ", " + _SUMMARY + " select image, size, n_aa, n_real, cast(largest as bigint) as largest, round((n_aa + n_real) / size, 9) as differing, round(n_real / size, 9) as real, round(cast(s as double) / n, 6) as mean, round(sqrt(greatest(cast(q as double) / n - (cast(s as double) / n) * (cast(s as double) / n), 0)), 6) as sd from u")
def image_diff_summary(t: Inputs) -> DataFrame:
    found = diff.summary(_mask(t))
    return found.select("image", "size", "n_aa", "n_real", F.col("largest").cast("long").alias("largest"), F.round("differing", 9).alias("differing"), F.round("real", 9).alias("real"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(_MASK + " select image, y, x, cast(class as integer) as class, cast(distance as bigint) as distance from k")
def image_pixel_mask(t: Inputs) -> DataFrame:
    return _mask(t)


@query("with " + _PAIRS.split("w as")[0].rstrip(", \n") + " select coalesce(image, -1) as image, count(*) as n, count(*) filter (r0 is null) as right_only, count(*) filter (r1 is null) as left_only from p group by 1")
def image_pixel_alignment(t: Inputs) -> DataFrame:
    left = t.left_pixels.select("image", "y", "x", F.lit(1).alias("l"))
    right = t.right_pixels.select("image", "y", "x", F.lit(1).alias("r"))
    both = left.join(right, ["image", "y", "x"], "full")
    return both.groupBy("image").agg(F.count("*").alias("n"), F.count_if(F.col("l").isNull()).alias("right_only"), F.count_if(F.col("r").isNull()).alias("left_only"))


@query(_MASK + ", " + _SUMMARY + """, f as (select image from {sizes} where image % 3 <> 0), r as (select distinct image + (case when image % 17 = 0 then 100000 else 0 end) as image from {sizes}),
 j as (select r.image, f.image is not null as there, u.n_aa, u.n_real from r left join f on f.image = r.image left join u on u.image = r.image)
 select count(*) as total, count(*) filter (not there) as missing, count(*) filter (there and n_aa + n_real = 0) as identical, count(*) filter (there and n_aa + n_real > 0 and n_real = 0) as antialiasing_only, count(*) filter (there and n_real > 0) as differing from j""")
def image_report_tally(t: Inputs) -> DataFrame:
    references = t.sizes.select((F.col("image") + F.when(F.col("image") % 17 == 0, 100000).otherwise(0)).alias("image"))
    return diff.tally(diff.summary(_mask(t)), references, t.sizes.filter("image % 3 <> 0"))


@query(_MASK + ", " + _SUMMARY + " select image, row_number() over (order by n_real / size desc, (n_aa + n_real) / size desc, image) as place from u")
def image_report_order(t: Inputs) -> DataFrame:
    return diff.report_order(diff.summary(_mask(t))).select("image", F.col("place").cast("long").alias("place"))


@query(_MASK + " select image, y // 16 as block_y, x // 16 as block_x, count(*) as score from k where class = 2 group by all")
def image_block_scores(t: Inputs) -> DataFrame:
    return diff.block_scores(_mask(t))


_WORST = """z as (select image, max(x) + 1 as w, max(y) + 1 as h from k group by image),
b as (select image, y // 16 as block_y, x // 16 as block_x, count(*) as n from k where class = 2 group by all),
f as (select * from b qualify row_number() over (partition by image order by n desc, block_y, block_x) = 1),
g as (select f.image, least(16, w, h) as size, greatest(0, least(block_x * 16 + 8 - least(16, w, h) // 2, w - least(16, w, h))) as x, greatest(0, least(block_y * 16 + 8 - least(16, w, h) // 2, h - least(16, w, h))) as y from f join z using (image))"""


@query(_MASK + ", " + _WORST + " select image, x, y, size from g")
def image_worst_region(t: Inputs) -> DataFrame:
    return diff.worst_block(saved(_mask(t), "mask"), 16).select("image", "x", "y", F.col("size").cast("long").alias("size"))


@query(_MASK + ", " + _WORST + " select g.image, g.x as sx, g.y as sy, g.size, count(*) as real_px from g join k on k.image = g.image and k.class = 2 and k.x >= g.x and k.x < g.x + g.size and k.y >= g.y and k.y < g.y + g.size group by all")
def image_region_count(t: Inputs) -> DataFrame:
    pixels = saved(_mask(t), "mask")
    return diff.count_in(pixels, diff.worst_block(pixels, 16)).select("image", "sx", "sy", F.col("size").cast("long").alias("size"), "real_px").filter("real_px > 0")


@query()
def image_worst_regions(t: Inputs) -> DataFrame:
    return diff.worst_regions(saved(_mask(t), "mask"), 0, 16)


@query("""select image, cast(i as bigint) as y, cast(j as bigint) as x, coalesce(r, 32) as r, coalesce(g, 32) as g, coalesce(b, 32) as b from (select distinct image from {sizes}) z
 cross join (select i from {numbers} where i < 12) a cross join (select i as j from {numbers} where i < 12) c left join {right_pixels} p on p.image = z.image and p.x = 26 + c.j and p.y = 26 + a.i""".replace("select image, cast", "select z.image, cast"))
def image_crop(t: Inputs) -> DataFrame:
    regions = t.sizes.select("image", F.lit(1).alias("rank"), F.lit(26).alias("x"), F.lit(26).alias("y"))
    return diff.crop(t.right_pixels, regions, 12).select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "r", "g", "b")


@query("select image, y * 2 + unnest([0, 0, 1, 1]) as y, x * 2 + unnest([0, 1, 0, 1]) as x, r, g, b from {left_pixels}")
def image_magnify(t: Inputs) -> DataFrame:
    return diff.magnify(t.left_pixels, 2)


@query("select s_suppkey, s_suppkey * 97 % 20000 as w, s_suppkey * 31 % 15000 as h, cast(s_suppkey * 97 % 20000 as bigint) * (s_suppkey * 31 % 15000) * 3 > 536870912 as too_big from {supplier}")
def image_overview_limit(t: Inputs) -> DataFrame:
    sized = t.sql("select s_suppkey, s_suppkey * 97 % 20000 as w, s_suppkey * 31 % 15000 as h from {supplier}")
    return sized.withColumn("too_big", diff.too_big_for_overview(F.col("w"), F.col("h")))
