"""From map tables to pictures: draws, shapes, extents, tiles and images, as plans keyed by map.

Combined symbols are taken apart once a symbol; objects meet what they draw with in a join, and every draw is expanded
where its row is. One aggregate gives each map's extent and size. Shapes go to the tiles that their boxes touch, and each
tile is painted by itself in colour order, so no map is ever whole in one task until a file of it is asked for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.operators import maps as O
from tessera.operators.expand import Expander
from tessera.operators.raster import Tile, coverage, stroke_polygons
from tessera.scratch import saved
from tessera.sources.png import encode
from tessera.sources.xmap import MapTables

#: Pixels a metre on the ground and the white frame in metres, where nothing else is said.
RESOLUTION, FRAME = 3.0, 50.0
TILE, FINE = 256, 0.0005

_SHAPES = (
    "map_id string, object_seq int, way array<int>, step int, color int, width double, cap string, join string, miter_clip boolean, rule string, clip int, "
    "lines array<struct<closed:boolean,x:array<double>,y:array<double>>>, clip_lines array<struct<closed:boolean,x:array<double>,y:array<double>>>, l double, t double, r double, b double, el double, et double, er double, eb double"
)


def draws(t: MapTables) -> DataFrame:
    """map_id, object_seq, way, priorities, symbol, body: what each visible object draws with, combined symbols taken
    apart; way is the row of part numbers from the object's symbol down."""
    symbols = t.symbols
    objects = O.resolved(t.objects, symbols.filter("parent is null")).filter("symbol_seq is not null")
    shown = symbols.filter(O.is_visible(F.col("is_hidden"), F.col("is_helper")))
    facts = saved(shown.select("map_id", F.col("seq").alias("symbol_seq"), "symbol_type", F.col("body").alias("symbol")), "symbols")
    parts = O.resolved_parts(t.parts, symbols.filter("parent is null")).withColumn("part", F.coalesce("part", "own"))
    parts = parts.join(facts.select("map_id", F.col("symbol_seq").alias("part")), ["map_id", "part"])
    kind = F.col("symbol_type") == O.COMBINED
    down = O.ways(parts).select("map_id", F.col("top").alias("symbol_seq"), F.col("seq").alias("part"), F.col("path").alias("way"))
    leaves = down.join(facts.filter(~kind).select("map_id", F.col("symbol_seq").alias("part"), "symbol"), ["map_id", "part"]).select("map_id", "symbol_seq", "way", "symbol")
    drawn = objects.select("map_id", "object_seq", "symbol_seq", "body").join(facts, ["map_id", "symbol_seq"])
    whole = drawn.filter(~kind).select("map_id", "object_seq", F.array().cast("array<int>").alias("way"), "symbol", "body")
    found = whole.unionByName(drawn.filter(kind).drop("symbol").join(leaves, ["map_id", "symbol_seq"]).select("map_id", "object_seq", "way", "symbol", "body"))
    colors = t.colors.groupBy("map_id").agg(F.sort_array(F.collect_list("priority")).alias("priorities"))
    return found.join(colors, "map_id", "left").withColumn("priorities", F.concat(F.coalesce("priorities", F.array().cast("array<int>")), F.array(F.lit(O.REGISTRATION))))


def _lines(outline: P.Outline) -> list[dict]:
    out = []
    for line, (_, _, closed) in zip(outline.polygons(FINE), outline.subpaths, strict=True):
        out.append({"closed": closed, "x": [z.real for z in line], "y": [z.imag for z in line]})
    return out


def _expanded(batches: Iterator[pd.DataFrame], fonts: object) -> Iterator[pd.DataFrame]:
    parsed: dict[str, dict] = {}
    from tessera.operators.text import draw_text

    for b in batches:
        rows = []
        for map_id, seq, way, symbol, body, priorities in zip(b.map_id, b.object_seq, b.way, b.symbol, b.body, b.priorities, strict=True):
            if symbol not in parsed:
                if len(parsed) > 2_000:
                    parsed.clear()
                parsed[symbol] = json.loads(symbol)
            e = Expander(frozenset(map(int, priorities)), draw_text)
            e.draw(parsed[symbol], json.loads(body))
            ext = e.extent or (None,) * 4
            for i, s in enumerate(e.shapes):
                lines = _lines(s.outline)
                box = P.box_of([complex(x, y) for p in lines for x, y in zip(p["x"], p["y"], strict=True)])
                pad = s.width * 2
                rows.append((map_id, seq, list(way), i, s.color, s.width, s.cap, s.join, s.miter_clip, s.rule, s.clip, lines, _lines(e.clips[s.clip]) if s.clip is not None else None, box[0] - pad, box[1] - pad, box[2] + pad, box[3] + pad, *ext))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SHAPES.replace("struct<closed:boolean,x:array<double>,y:array<double>>", "s").split(", ")]).astype({"clip": "Int32"})


def shapes(t: MapTables, fonts: object = None) -> DataFrame:
    """Every drawing step with its polygons in mm, its box and its draw's extent."""
    ready = draws(t).select("map_id", "object_seq", "way", "symbol", "body", "priorities")
    return ready.mapInPandas(lambda b: _expanded(b, fonts), _SHAPES)


def extents(t: MapTables, drawn: DataFrame) -> DataFrame:
    """map_id, l, t, r, b in mm for every map that could be read; a map that draws nothing has a point at the origin."""
    boxes = drawn.filter("el is not null").groupBy("map_id").agg(F.min("el").alias("l"), F.min("et").alias("t"), F.max("er").alias("r"), F.max("eb").alias("b"))
    zero = F.lit(0.0)
    return t.maps.filter("error is null").select("map_id", "scale_denominator").join(boxes, "map_id", "left").select("map_id", "scale_denominator", *[F.coalesce(c, zero).alias(c) for c in "ltrb"])


def sizes(found: DataFrame, resolution: float = RESOLUTION, frame: float = FRAME) -> DataFrame:
    """extents() with px (pixels a mm), x0, y0 (the picture's corner in mm), w and h in pixels, and ground_w and
    ground_h in whole metres."""
    per_metre = 1000.0 / F.col("scale_denominator")
    px = F.lit(float(resolution)) * F.col("scale_denominator") / 1000.0
    edge = F.lit(float(frame)) * per_metre
    framed = found.select("*", px.alias("px"), (F.col("l") - edge).alias("x0"), (F.col("t") - edge).alias("y0"), (F.col("r") + edge).alias("x1"), (F.col("b") + edge).alias("y1"))
    side = lambda a, b: F.col(b) - F.col(a)
    return framed.select("map_id", "scale_denominator", "px", "x0", "y0", *[F.round(side(f"{c}0", f"{c}1") * F.col("px")).cast("int").alias(n) for c, n in (("x", "w"), ("y", "h"))], *[F.round(side(f"{c}0", f"{c}1") / per_metre).cast("long").alias(n) for c, n in (("x", "ground_w"), ("y", "ground_h"))])


def tiles(t: MapTables, drawn: DataFrame, size: DataFrame) -> DataFrame:
    """map_id, ty, tx, w, h, rgb: pictures of 256 x 256 pixels and less at the edges. A tile's group holds the shapes
    that touch it."""
    count = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    every = size.filter("w > 0 and h > 0").withColumn("ty", F.explode(F.sequence(F.lit(0), count("h") - 1))).withColumn("tx", F.explode(F.sequence(F.lit(0), count("w") - 1)))
    black = O.with_registration(t.colors)
    colored = drawn.join(black.select("map_id", F.col("priority").alias("color"), F.array(F.col("r").cast("double"), F.col("g").cast("double"), F.col("b").cast("double"), "opacity").alias("rgba")), ["map_id", "color"])
    place = lambda mm, origin: F.floor(((F.col(mm) - F.col(origin)) * F.col("px")) / TILE).cast("int")
    limit = lambda c, n: F.least(F.greatest(c, F.lit(0)), count(n) - 1)
    spread = colored.join(size.select("map_id", "px", "x0", "y0", "w", "h"), "map_id")
    spread = spread.withColumn("ty", F.explode(F.sequence(limit(place("t", "y0"), "h"), limit(place("b", "y0"), "h")))).withColumn("tx", F.explode(F.sequence(limit(place("l", "x0"), "w"), limit(place("r", "x0"), "w"))))
    wanted = spread.select("map_id", "ty", "tx", "color", "object_seq", "way", "step", "width", "cap", "join", "miter_clip", "rule", "clip", "lines", "clip_lines", "rgba")
    frame = every.select("map_id", "ty", "tx", "px", "x0", "y0", "w", "h")
    return wanted.groupBy("map_id", "ty", "tx").cogroup(frame.groupBy("map_id", "ty", "tx")).applyInPandas(_painted, "map_id string, ty int, tx int, w int, h int, rgb binary")


def _painted(rows: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
    columns = ["map_id", "ty", "tx", "w", "h", "rgb"]
    if frame.empty:
        return pd.DataFrame([], columns=columns)
    f = frame.iloc[0]
    w, h = min(TILE, int(f.w) - int(f.tx) * TILE), min(TILE, int(f.h) - int(f.ty) * TILE)
    tile = Tile(w, h)
    origin = complex(f.x0, f.y0)
    corner = complex(int(f.tx) * TILE, int(f.ty) * TILE)

    def pixels(lines) -> list[tuple[bool, np.ndarray]]:
        return [(bool(p["closed"]), ((np.asarray(p["x"]) + 1j * np.asarray(p["y"])) - origin) * f.px - corner) for p in lines]

    rows = rows.assign(order=[tuple(x) for x in rows.way]) if len(rows) else rows
    # by falling priority, so registration black (-900) comes last; then as made
    for r in rows.sort_values(["color", "object_seq", "order", "step"], ascending=[False, True, True, True], kind="stable").itertuples() if len(rows) else ():
        lines = pixels(r.lines)
        if r.width > 0:
            half = r.width / 2 * f.px
            polygons = [p for closed, z in lines for p in stroke_polygons(z, closed, half, r.cap, r.join, bool(r.miter_clip))]
            cover = coverage(polygons, w, h, "winding")
        else:
            cover = coverage([z for _, z in lines], w, h, r.rule)
        clip = None
        clipped = r.clip_lines is not None
        if clipped and cover is not None:
            clip = tile.mask((r.object_seq, r.order, r.clip), [z for _, z in pixels(r.clip_lines)])
        tile.paint(cover, tuple(r.rgba[:3]), r.rgba[3], clip, clipped)
    return pd.DataFrame([(f.map_id, int(f.ty), int(f.tx), w, h, tile.bytes().tobytes())], columns=columns)


def images(made: DataFrame, kind: str = "png") -> DataFrame:
    """map_id, w, h, content: each map's tiles as one file. Only here is a map's picture whole in a task."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        h = int((rows.ty * TILE + rows.h).max())
        w = int((rows.tx * TILE + rows.w).max())
        out = np.zeros((h, w, 3), np.uint8)
        for r in rows.itertuples():
            out[r.ty * TILE : r.ty * TILE + r.h, r.tx * TILE : r.tx * TILE + r.w] = np.frombuffer(r.rgb, np.uint8).reshape(r.h, r.w, 3)
        from tessera.sources.png import encode_as

        return pd.DataFrame([(rows.map_id.iloc[0], w, h, encode(out) if kind == "png" else encode_as(out, f"x.{kind}"))], columns=["map_id", "w", "h", "content"])

    return made.groupBy("map_id").applyInPandas(join, "map_id string, w int, h int, content binary")


def render(t: MapTables, resolution: float = RESOLUTION, frame: float = FRAME, kind: str = "png") -> DataFrame:
    """map_id, w, h, content, ground_w, ground_h, scale_denominator for every map that could be read."""
    drawn = shapes(t).persist()
    size = sizes(extents(t, drawn), resolution, frame).persist()
    found = images(tiles(t, drawn, size), kind)
    return found.join(size.select("map_id", "ground_w", "ground_h", "scale_denominator"), "map_id")
