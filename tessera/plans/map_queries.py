"""Queries of maps, symbols, paths and sheets over derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import math as M
from tessera.operators import maps as O
from tessera.plans.registry import Inputs, query
from tessera.scratch import tasks

# colours and predicates
@query("select map_id, priority, round(cast(1 - (cast(c as float) * (1 - cast(k as float)) + cast(k as float)) as double), 5) as r, round(cast(1 - (cast(m as float) * (1 - cast(k as float)) + cast(k as float)) as double), 5) as g, round(cast(1 - (cast(y as float) * (1 - cast(k as float)) + cast(k as float)) as double), 5) as b from {colors}")
def color_from_ink(t: Inputs) -> DataFrame:
    rgb = M.cmyk_to_rgb(F.col("c"), F.col("m"), F.col("y"), F.col("k"))
    return t.colors.select("map_id", "priority", *[F.round(rgb[x].cast("double"), 5).alias(x) for x in "rgb"])


@query("select seq, is_hidden, is_helper, not is_hidden and not is_helper as visible, (inner_color >= 0 or inner_color = -900) as colored, elements = 0 and not (inner_color >= 0 and inner_radius > 0) and not (outer_color >= 0 and outer_width > 0) as empty, border_color >= 0 and border_width > 0 as border from {symbols}")
def symbol_predicates(t: Inputs) -> DataFrame:
    c = F.col
    return t.symbols.select("seq", "is_hidden", "is_helper", O.is_visible(c("is_hidden"), c("is_helper")).alias("visible"), O.is_color(c("inner_color")).alias("colored"), O.is_empty_point(c("inner_radius"), c("inner_color"), c("outer_width"), c("outer_color"), c("elements")).alias("empty"), O.is_visible_border(c("border_color"), c("border_width")).alias("border"))


@query("select r.m as map_id, r.color, count(*) as n, cast(sum(r.seq) as bigint) as seqs from (select *, map_id % 5 as m from {renderables}) r where r.color = -900 or exists (select 1 from {colors} p where p.map_id = r.m and p.priority = r.color) group by 1, 2")
def color_lookup(t: Inputs) -> DataFrame:
    rgb = M.cmyk_to_rgb(F.col("c"), F.col("m"), F.col("y"), F.col("k"))
    palette = t.colors.select("map_id", "priority", "name", *[rgb[x].alias(x) for x in "rgb"], F.lit(1.0).alias("opacity"))
    items = t.renderables.withColumn("map_id", F.col("map_id") % 5)
    return O.colored(items, palette).groupBy("map_id", "color").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query("select map_id, seq, color, pen_width from {renderables} where (color >= 0 or color = -900) and not is_empty and pen_width > 0")
def emitted_strokes(t: Inputs) -> DataFrame:
    return O.emitted(t.renderables).select("map_id", "seq", "color", "pen_width")


@query("select map_id, seq, color, row_number() over (partition by map_id order by color desc, seq) as place from {renderables}")
def paint_order(t: Inputs) -> DataFrame:
    return O.paint_order(t.renderables).select("map_id", "seq", "color", F.col("place").cast("long").alias("place"))


@query("select map_id, min(x) as l, min(y) as t, max(x + w) as r, max(y + h) as b from {renderables} where not clipped and not (w = 0 and h = 0) group by map_id")
def map_extents(t: Inputs) -> DataFrame:
    return O.extents(t.renderables)


@query("with e as (select map_id, max(x + w) - min(x) as w, max(y + h) - min(y) as h from {renderables} where not clipped and not (w = 0 and h = 0) group by map_id) select map_id, cast(round((w + 2 * 50 * 1000.0 / 10000) * 3.0 * 10000 / 1000) as bigint) as w, cast(round((h + 2 * 50 * 1000.0 / 10000) * 3.0 * 10000 / 1000) as bigint) as h from e")
def image_sizes(t: Inputs) -> DataFrame:
    boxes = O.extents(t.renderables).select("map_id", F.struct((F.col("r") - F.col("l")).alias("w"), (F.col("b") - F.col("t")).alias("h")).alias("extent"))
    size = M.image_size(F.col("extent"), F.lit(3.0), F.lit(10000.0), F.lit(50.0))
    return boxes.select("map_id", size["w"].alias("w"), size["h"].alias("h"))


# references
_IDS = "ids as (select map_id, file_id, max(seq) as seq from {symbols} where file_id >= 0 group by all)"


@query(f"with {_IDS} select o.map_id, o.object_seq, o.symbol_id, ids.seq as symbol_seq, count(*) as n from {{objects}} o left join ids on ids.map_id = o.map_id and ids.file_id = o.symbol_id group by all")
def resolve_objects(t: Inputs) -> DataFrame:
    return O.resolved(t.objects, t.symbols).groupBy("map_id", "object_seq", "symbol_id", "symbol_seq").agg(F.count("*").alias("n"))


_PARTS = _IDS + """, q as (select p.*, case when is_private then sum(is_private::int) over (partition by p.map_id, parent order by part_seq) - 1 end as owned from {parts} p),
pp as (select q.map_id, q.parent, q.part_seq, q.part_id, q.owned, case when not is_private then ids.seq end as part from q left join ids on ids.map_id = q.map_id and ids.file_id = q.part_id)"""


@query(f"with {_PARTS} select map_id, parent, part_seq, part_id, cast(owned as bigint) as owned, part from pp")
def resolve_parts(t: Inputs) -> DataFrame:
    return O.resolved_parts(t.parts, t.symbols).select("map_id", "parent", "part_seq", "part_id", F.col("owned").cast("long").alias("owned"), "part")


@query(f"with recursive {_PARTS}, tree as (select map_id, seq as root, seq, [seq] as through, 0 as level from {{symbols}} where symbol_type = 16 union all select t.map_id, t.root, pp.part, list_append(t.through, pp.part), t.level + 1 from tree t join pp on pp.map_id = t.map_id and pp.parent = t.seq where pp.part is not null and not list_contains(t.through, pp.part)) select map_id, root, level, count(*) as n, cast(sum(seq) as bigint) as seqs from tree group by all")
def part_tree(t: Inputs) -> DataFrame:
    tree = O.part_tree(t.symbols.filter("symbol_type = 16"), O.resolved_parts(t.parts, t.symbols))
    return tree.groupBy("map_id", "root", "level").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


_CLOSURE = _PARTS + ", tree as (select map_id, seq as root, seq from {symbols} where symbol_type = 16 union select t.map_id, t.root, pp.part from tree t join pp on pp.map_id = t.map_id and pp.parent = t.seq where pp.part is not null)"


@query(f"with recursive {_CLOSURE} select map_id, root, seq from tree")
def symbol_closure(t: Inputs) -> DataFrame:
    return O.closure(t.symbols.filter("symbol_type = 16"), O.resolved_parts(t.parts, t.symbols))


@query(f"with recursive {_CLOSURE} select t.map_id, t.root, bit_or(s.symbol_type) as types, coalesce(bool_or(is_rotatable) filter (s.symbol_type = 4), false) as rotatable, greatest(0, max(minimum_length) filter (s.symbol_type = 2)) as min_length, greatest(0, max(minimum_length) filter (s.symbol_type = 4)) as min_area from tree t join {{symbols}} s on s.map_id = t.map_id and s.seq = t.seq group by all")
def part_tree_facts(t: Inputs) -> DataFrame:
    tree = O.closure(t.symbols.filter("symbol_type = 16"), O.resolved_parts(t.parts, t.symbols))
    return O.tree_facts(tree, t.symbols)


@query(f"with recursive {_CLOSURE} select map_id, root, seq, row_number() over (partition by map_id, root order by seq) - 1 as new_id from tree")
def closure_renumbering(t: Inputs) -> DataFrame:
    from pyspark.sql import Window

    tree = O.closure(t.symbols.filter("symbol_type = 16"), O.resolved_parts(t.parts, t.symbols))
    return tree.withColumn("new_id", (F.row_number().over(Window.partitionBy("map_id", "root").orderBy("seq")) - 1).cast("long"))


@query("select map_id, 'object' as kind, count(*) as n, min(object_seq) as first from {objects} group by map_id union all select map_id, 'part', count(*), min(parent * 10 + part_seq) from {parts} group by map_id")
def merged_parts(t: Inputs) -> DataFrame:
    objects = t.objects.select("map_id", F.lit("object").alias("kind"), F.col("object_seq").alias("seq"))
    parts = t.parts.select("map_id", F.lit("part").alias("kind"), (F.col("parent") * 10 + F.col("part_seq")).alias("seq"))
    return objects.unionByName(parts).groupBy("map_id", "kind").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


# vectors, rounding, curves
_VECTORS = "select event_id, cast(event_id % 7 - 3 as double) as ax, cast(event_id % 5 - 2 as double) as ay, cast(event_id % 11 - 5 as double) as qx, value as qy from {events}"


@query(f"with v as ({_VECTORS}) select event_id, round(ax * qx + ay * qy, 6) as dot, round(sqrt(ax * ax + ay * ay), 6) as length, round(case when ax = 0 and ay = 0 then 0 else ax / sqrt(ax * ax + ay * ay) end, 6) as nx, 0.0 - ay as px, ax as py, round(case when ax = 0 and ay = 0 then 0 else 2.5 * ay / sqrt(ax * ax + ay * ay) end, 6) as wy, round(atan2(qy, qx), 6) as angle from v")
def vector_algebra(t: Inputs) -> DataFrame:
    a, b = M.point(F.col("ax"), F.col("ay")), M.point(F.col("qx"), F.col("qy"))
    r = lambda c: F.round(c, 6) + 0.0
    turned = M.perpendicular(a)
    return t.sql(_VECTORS).select("event_id", r(M.dot(a, b)).alias("dot"), r(M.length(a)).alias("length"), r(M.normalized(a)["x"]).alias("nx"), (turned["x"] + 0.0).alias("px"), turned["y"].alias("py"), r(M.with_length(a, F.lit(2.5))["y"]).alias("wy"), r(M.rotation(b)).alias("angle"))


_HALVES = "select event_id, cast(event_id % 4001 - 2000 as double) / 4 as v from {events}"


@query(f"with h as ({_HALVES}) select event_id, cast(floor(v + 0.5) as bigint) as up, round_even(v, 0) + 0.0 as even, cast(sign(v) * floor(abs(v) + 0.5) as double) + 0.0 as away, cast(floor(v * 1000 + 0.5) as bigint) as native from h")
def rounding_rules(t: Inputs) -> DataFrame:
    v = F.col("v")
    return t.sql(_HALVES).select("event_id", M.round_up(v).alias("up"), (M.round_even(v) + 0.0).alias("even"), (M.round_away(v) + 0.0).alias("away"), M.native(v).alias("native"))


_NEAR = "select event_id, value as a, value * (1 + case event_id % 4 when 0 then 0 when 1 then 1e-13 when 2 then 1e-6 else 1e-3 end) as b from {events}"


@query(f"with n as ({_NEAR}) select event_id, abs(a - b) * 1e12 <= least(abs(a), abs(b)) as near, abs(a - b) <= 1e-12 as zero from n")
def fuzzy_compare(t: Inputs) -> DataFrame:
    return t.sql(_NEAR).select("event_id", M.is_near(F.col("a"), F.col("b")).alias("near"), M.is_zero(F.col("a") - F.col("b")).alias("zero"))


_CURVES = "select event_id, value as v, cast(event_id % 13 - 1 as double) / 11 as p from {events}"


@query(f"with c as ({_CURVES}) select event_id, round(case when p <= 0 then 0 when p >= 1 then 10 else 3 * p * (1 - p) * (1 - p) * v + 3 * p * p * (1 - p) * (10 - v) + p * p * p * 10 end, 6) as x, round(case when p <= 0 then 0 when p >= 1 then 4 else 3 * p * (1 - p) * (1 - p) * 2 + 3 * p * p * (1 - p) * 6 + p * p * p * 4 end, 6) as y from c")
def bezier_split(t: Inputs) -> DataFrame:
    point = lambda x, y: M.point(F.lit(x) if isinstance(x, float) else x, F.lit(y))
    middle = F.element_at(M.split_bezier(point(0.0, 0.0), point(F.col("v"), 2.0), point(10 - F.col("v"), 6.0), point(10.0, 4.0), F.col("p")), 3)
    return t.sql(_CURVES).select("event_id", F.round(middle["x"], 6).alias("x"), F.round(middle["y"], 6).alias("y"))


@query("select p_partkey, round(cx + half * cast(case i when 0 then 1 when 1 then 1 when 2 then 0.5522847498 when 3 then 0 when 4 then -0.5522847498 when 5 then -1 when 6 then -1 when 7 then -1 when 8 then -0.5522847498 when 9 then 0 when 10 then 0.5522847498 when 11 then 1 else 1 end as double), 6) as x, i from (select shape as p_partkey, cx, half from {squares}) s cross join (select i from {numbers} where i < 13) n")
def ellipse_points(t: Inputs) -> DataFrame:
    c = F.col
    e = M.ellipse(c("cx").cast("double"), c("cy").cast("double"), c("half").cast("double"), c("half").cast("double"))
    return t.squares.select(c("shape").alias("p_partkey"), F.posexplode(e).alias("i", "p")).select("p_partkey", F.round("p.x", 6).alias("x"), F.col("i").cast("long").alias("i"))


@query("select shape, round(cx + 2 * (half * cos(kind) - half * sin(kind)), 6) as x, round(cy + 2 * (half * sin(kind) + half * cos(kind)), 6) as y from {squares}")
def element_placement(t: Inputs) -> DataFrame:
    c = F.col
    moved = F.element_at(M.placed(F.array(M.point(c("half"), c("half"))), M.point(c("cx"), c("cy")), c("kind").cast("double"), F.lit(2.0)), 1)
    return t.squares.select("shape", F.round(moved["x"], 6).alias("x"), F.round(moved["y"], 6).alias("y"))


@query("select s_suppkey, 1000.0 / (s_suppkey * 500 + 4000) as mm, 6.0 * (s_suppkey * 500 + 4000) / 1000 as px from {supplier}")
def scale_factors(t: Inputs) -> DataFrame:
    scale = (F.col("s_suppkey") * 500 + 4000).cast("double")
    return t.supplier.select("s_suppkey", M.mm_per_metre(scale).alias("mm"), M.pixels_per_mm(F.lit(6.0), scale).alias("px"))


def _ring():
    c = F.col
    corner = lambda dx, dy: M.point(c("cx") + dx * c("half"), c("cy") + dy * c("half"))
    return corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)


@query("select shape, i, (cx - half <= i * 30 and i * 30 < cx + half and cy - half <= cy + i - 4 and cy + i - 4 < cy + half) as inside from {squares} cross join (select i from {numbers} where i < 30) n")
def point_in_path(t: Inputs) -> DataFrame:
    at = M.point(F.col("i") * 30, F.col("cy") + F.col("i") - 4)
    # the squares come from few files, even from one
    spread = t.squares.repartition(tasks(t.spark, t.part.count() * 30), "shape")
    return spread.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long")))).select("shape", "i", O.inside_polygon(_ring(), at).alias("inside"))


@query("""with s as (select *, kind as mode, cx + half - 1 as px, cy + half - 2 as py from {squares} where kind > 0),
q as (select *, (px - 2 >= cx - half and px - 2 < cx + half and py >= cy - half and py < cy + half) as w, (px + 2 >= cx - half and px + 2 < cx + half and py >= cy - half and py < cy + half) as e, (px >= cx - half and px < cx + half and py - 2 >= cy - half and py - 2 < cy + half) as n, (px >= cx - half and px < cx + half and py + 2 >= cy - half and py + 2 < cy + half) as s, (px >= cx - half and px < cx + half and py >= cy - half and py < cy + half) as m from s)
select shape, mode, case mode when 1 then w and e and n and s when 3 then w or e or n or s else m end as kept, case mode when 1 then w and e when 3 then w or e else m end as element from q""")
def placement_modes(t: Inputs) -> DataFrame:
    c = F.col
    at = M.point(c("cx") + c("half") - 1, c("cy") + c("half") - 2)
    tips = M.point(at["x"] - 2, at["y"]), M.point(at["x"] + 2, at["y"])
    return t.squares.filter("kind > 0").select("shape", c("kind").alias("mode"), O.placed_inside(at, F.lit(2.0), _ring(), c("kind")).alias("kept"), O.element_inside(tips, _ring(), c("kind")).alias("element"))


# polylines
_CUT = """c as (select line, i, x, y, flags, coalesce(sum(case when flags & 16 > 0 then 1 else 0 end) over (partition by line order by i rows between unbounded preceding and 1 preceding), 0) + 1 as part from {points}),
k as (select *, count(*) over (partition by line, part) as n from c), p as (select * exclude (n) from k where n >= 2)"""
_LENGTH = _CUT + ", s as (select *, coalesce(sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)), 0) as step from p window w as (partition by line, part order by i)), g as (select line, part, i, x, y, flags, sum(step) over (partition by line, part order by i) as length from s)"


@query(f"with {_CUT} select line, i, cast(part as bigint) as part from p")
def path_parts(t: Inputs) -> DataFrame:
    return O.line_parts(t.points).select("line", "i", "part")


def _lengths(t: Inputs) -> DataFrame:
    return O.running_length(O.line_parts(t.points))


@query(f"with {_LENGTH} select line, i, round(length, 4) as length from g")
def running_length(t: Inputs) -> DataFrame:
    return _lengths(t).select("line", "i", F.round("length", 4).alias("length"))


@query(f"with {_LENGTH}, e as (select *, i = min(i) over w as f, i = max(i) over w as l from g window w as (partition by line, part)), d as (select * from e where f or l or flags & 32 > 0) select line, cast(part as bigint) as part, round(length, 4) as begin, round(lead(length) over (partition by line, part order by i), 4) as \"end\" from d qualify \"end\" is not null")
def dash_sections(t: Inputs) -> DataFrame:
    return O.sections(_lengths(t)).select("line", "part", F.round("begin", 4).alias("begin"), F.round("end", 4).alias("end"))


@query(f"with {_LENGTH} select line, i, round(min(case when flags & 32 > 0 then length end) over (partition by line, part order by i rows between 1 following and unbounded following), 4) as next_dash from g")
def next_dash_point(t: Inputs) -> DataFrame:
    return O.next_dash_point(_lengths(t)).select("line", "i", F.round("next_dash", 4).alias("next_dash"))


@query(f"with {_CUT} select line, i, round(atan2(cast(coalesce(lead(y) over w - y, y - lag(y) over w) as double), cast(coalesce(lead(x) over w - x, x - lag(x) over w) as double)), 6) as angle from p window w as (partition by line, part order by i)")
def path_tangents(t: Inputs) -> DataFrame:
    return O.tangents(O.line_parts(t.points)).select("line", "i", F.round("angle", 6).alias("angle"))


def _gathered(t: Inputs) -> DataFrame:
    """Lines as arrays of points, in order."""
    rows = F.array_sort(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    return t.points.groupBy("line").agg(rows.alias("p")).select("line", F.transform("p", lambda r: M.point(r["x"], r["y"])).alias("p"))


@query("select line, cast(min(x) as double) as l, cast(min(y) as double) as t, cast(max(x) as double) as r, cast(max(y) as double) as b from {points} group by line having count(*) > 1")
def path_bounding_box(t: Inputs) -> DataFrame:
    box = O.bounding_box(F.col("p"))
    return _gathered(t).filter(F.size("p") > 1).select("line", *[box[s].alias(s) for s in "ltrb"]).select("line", *[F.round(s, 3).alias(s) for s in "ltrb"])


@query("select line, round(avg(x), 4) as x, round(avg(y), 4) as y from {points} group by line")
def path_centroid(t: Inputs) -> DataFrame:
    middle = O.centroid(F.col("p"))
    return _gathered(t).select("line", F.round(middle["x"], 4).alias("x"), F.round(middle["y"], 4).alias("y"))


@query("with s as (select line, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as d from {points} window w as (partition by line order by i)) select line, cast(round(sum(d) / 100) as bigint) as hundreds from s group by line")
def path_length(t: Inputs) -> DataFrame:
    return O.path_length(t.points).select("line", F.round(F.col("length") / 100).cast("long").alias("hundreds"))


# layouts
_SECTIONS = "select p_partkey, cast(p_size * 3 + p_partkey % 10 as double) as len, cast(p_partkey % 3 + 2 as double) as dash, cast(p_size % 2 + 1 as double) as gap, p_partkey % 2 = 0 as half_first, p_size % 3 = 0 as half_last from {part}"


@query(f"""with s as ({_SECTIONS}), a as (select *, (half_first::int + half_last::int) as h, dash + gap as period from s), n as (select *, h + (len + gap - h * dash / 2) / period as n, 2 - h // 2 as least from a),
b as (select *, floor(n) as lo, ceil(n) as hi from n)
select p_partkey, cast(case when len <= 0 or (lo <= 1 and len < 2 * period - least * 0.2 * period) then 0 when (len + gap - lo * period) / lo > (hi * period - len - gap) / hi then hi else lo end as integer) as dashes from b""")
def dash_counts(t: Inputs) -> DataFrame:
    c = F.col
    return t.sql(_SECTIONS).select("p_partkey", O.dash_count(c("len"), c("dash"), c("gap"), c("half_first"), c("half_last")).alias("dashes"))


@query("select p_partkey, cast(i as bigint) as i, round(cast(p_size * 3 as double) * i / greatest(1, floor(p_size * 3 / 4.0 + 0.5)), 6) as at from {part} join {numbers} n on n.i >= 1 and n.i < greatest(1, floor(p_size * 3 / 4.0 + 0.5))")
def mid_symbol_spots(t: Inputs) -> DataFrame:
    spots = O.mid_spots((F.col("p_size") * 3).cast("double"), F.lit(4.0))
    return t.part.select("p_partkey", F.posexplode(spots).alias("i", "at")).select("p_partkey", (F.col("i") + 1).cast("long").alias("i"), F.round("at", 6).alias("at"))


@query("""with s as (select shape, cx - half as low, cx + half as high, 0.75 as gap, kind * 0.25 as off from {squares})
select shape, count(*) as n, round(min(spot), 6) as first, round(max(spot), 6) as last from (select shape, high, off + (ceil((low - off) / gap) + i) * gap as spot from s cross join {numbers} n where n.i < 64) q where spot < high group by shape""")
def pattern_lines(t: Inputs) -> DataFrame:
    c = F.col
    lines = O.pattern_lines((c("cx") - c("half")).cast("double"), (c("cx") + c("half")).cast("double"), F.lit(0.75), c("kind") * F.lit(0.25))
    return t.squares.select("shape", F.explode(lines).alias("at")).groupBy("shape").agg(F.count("*").alias("n"), F.round(F.min("at"), 6).alias("first"), F.round(F.max("at"), 6).alias("last"))


_CELLS = "select p_size as sheet, p_partkey as object, p_partkey % 7 as row, p_partkey % 5 as col, cast(p_partkey % 40 as double) / 4 as l, cast(p_partkey % 24 as double) / 8 as t, cast(p_partkey % 9 as double) / 2 as w, cast(p_partkey % 11 as double) / 4 as h from {part}"


@query(f"""with c as ({_CELLS}), cw as (select sheet, col, max(w) as s from c group by all), rh as (select sheet, row, max(h) as s from c group by all),
cg as (select *, greatest(2.0, 0.15 * max(s) over (partition by sheet)) as gap from cw), rg as (select *, greatest(2.0, 0.15 * max(s) over (partition by sheet)) as gap from rh),
cl as (select sheet, col, coalesce(sum(s + gap) over (partition by sheet order by col rows between unbounded preceding and 1 preceding), 0) + s / 2 as mid from cg),
rt as (select sheet, row, coalesce(sum(s + gap) over (partition by sheet order by row rows between unbounded preceding and 1 preceding), 0) + s / 2 as mid from rg)
select c.sheet, c.object, c.row, c.col, cast(floor((cl.mid - (l + w / 2)) * 1000 + 0.5) as bigint) as dx, cast(floor((rt.mid - (t + h / 2)) * 1000 + 0.5) as bigint) as dy from c join cl on cl.sheet = c.sheet and cl.col = c.col join rt on rt.sheet = c.sheet and rt.row = c.row""")
def sheet_layout(t: Inputs) -> DataFrame:
    return O.grid_layout(t.sql(_CELLS))


@query(f"with c as ({_CELLS}) select sheet, string_agg('row ' || row || ': ' || names, chr(10) order by row) as description from (select sheet, row, string_agg(cast(object as varchar), ', ' order by col, object) as names from c group by all) q group by sheet")
def sheet_description(t: Inputs) -> DataFrame:
    cells = t.sql(_CELLS)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "object"))), lambda c: c["object"].cast("string")), ", ")
    rows = cells.groupBy("sheet", "row").agg(names.alias("names")).select("sheet", F.struct("row", F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(": "), F.col("names")).alias("line")).alias("r"))
    return rows.groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("description"))


@query(f"""with {_LENGTH}, e as (select *, max(length) over (partition by line, part) * 0.5 as half, lead(x) over w as x2, lead(y) over w as y2, lead(length) over w as length2 from g window w as (partition by line, part order by i))
select line, cast(part as bigint) as part, round(x + (x2 - x) * (half - length) / (length2 - length), 4) as x, round(y + (y2 - y) * (half - length) / (length2 - length), 4) as y from e where length <= half and half < length2""")
def path_positions(t: Inputs) -> DataFrame:
    return O.positions(_lengths(t), 0.5).select("line", "part", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("""with s as (select shape, cast(half * 4 as double) as length, cast(cx as double) as along, cast(kind as double) / 4 as off from {squares}), f as (select *, ceil((along - off) / 1.25) * 1.25 - (along - off) as first from s)
select shape, count(*) as n, round(min(first + i * 1.25), 6) as first, round(max(first + i * 1.25), 6) as last from f join {numbers} n on first + i * 1.25 < length group by shape""")
def pattern_sites(t: Inputs) -> DataFrame:
    c = F.col
    sites = O.pattern_sites((c("half") * 4).cast("double"), c("cx").cast("double"), F.lit(1.25), c("kind").cast("double") / 4)
    return t.squares.select("shape", F.explode(sites).alias("s")).groupBy("shape").agg(F.count("*").alias("n"), F.round(F.min("s"), 6).alias("first"), F.round(F.max("s"), 6).alias("last"))


@query("""select seq, 'dot' as step, inner_color as color, cast(inner_radius as double) as radius, 0.0::double as width, cast(inner_radius as double) as reach from {symbols} where inner_color >= 0 and inner_radius > 0
union all select seq, 'ring', outer_color, inner_radius + outer_width / 2.0, outer_width, inner_radius + outer_width from {symbols} where outer_color >= 0 and outer_width > 0""")
def point_steps(t: Inputs) -> DataFrame:
    c = F.col
    steps = t.symbols.select("seq", F.explode(O.point_steps(c("inner_radius"), c("inner_color"), c("outer_width"), c("outer_color"))).alias("s"))
    return steps.select("seq", F.when(c("s.width") > 0, "ring").otherwise("dot").alias("step"), "s.color", "s.radius", "s.width", "s.reach")


@query("""select seq, cast(case symbol_type when 8 then 8 when 1 then case when is_rotatable then 8 else 1 end when 2 then 15 + case when minimum_length > 0 then 2 else 0 end
 when 4 then case when elements > 1 then 54 else 12 end + case when minimum_length > 0 then 2 else 0 end else 15 + case when minimum_length > 0 then 2 else 0 end end as integer) as cells from {symbols}""")
def sheet_cell_counts(t: Inputs) -> DataFrame:
    c = F.col
    return t.symbols.select("seq", O.sheet_cells(c("symbol_type"), c("symbol_type"), c("is_rotatable"), c("elements") > 1, c("minimum_length"), c("minimum_length")).alias("cells"))


@query("""select p_partkey, cast(i as integer) as i, cast(floor(p_size * 50 * case i when 0 then -0.5 when 1 then -1.0 / 6 when 2 then 1.0 / 6 else 0.5 end + 0.5) as bigint) as x, cast(floor(p_size * 50 * case i % 2 when 0 then 0.25 else -0.25 end + 0.5) as bigint) as y from {part} cross join {numbers} n where n.i < 4""")
def shape_coordinates(t: Inputs) -> DataFrame:
    points = O.shape_points("zigzag", (F.col("p_size") * 50).cast("double"))
    return t.part.select("p_partkey", F.posexplode(points).alias("i", "p")).select("p_partkey", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


@query("""select conv_id, turn, '<object type="4" symbol="' || turn || '" h_align="1" v_align="2"><coords count="2">' || conv_id || ' ' || turn || ' 32;' || (conv_id * 1500) || ' -250;</coords><text>'
 || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</text></object>' as element from {conversations}""")
def object_elements(t: Inputs) -> DataFrame:
    from tessera.operators.writer import object_element

    at = lambda x, y, f: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(f).alias("flags"))
    points = F.array(at(F.col("conv_id") / 1000, F.col("turn") / 1000, 32), at(F.col("conv_id") * 1.5, F.lit(-0.25), 0))
    none = F.lit(None).cast("string")
    element = object_element(F.lit(4), F.col("turn").cast("int"), points, none, F.lit(1), F.lit(2), F.col("text"), F.lit("0"), F.lit(0.0), F.lit(0.0))
    return t.conversations.select("conv_id", "turn", element.alias("element"))
