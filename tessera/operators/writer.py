"""Map files: objects as elements by column expressions, and whole files."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import math as M
from tessera.functions import text as T
from tessera.functions.number import native, qt_number

#: The format's version and name space.
VERSION, SPACE = 9, "http://openorienteering.org/apps/mapper/xml/v2"


def coords_text(coords: Column) -> Column:
    """array<struct<x, y, flags>> in mm as "x y[ flags];" records."""
    one = lambda c: F.concat(M.native(c["x"]).cast("string"), F.lit(" "), M.native(c["y"]).cast("string"), F.when(c["flags"] != 0, F.concat(F.lit(" "), c["flags"].cast("string"))).otherwise(""), F.lit(";"))
    return F.array_join(F.transform(coords, one), "")


def object_element(kind: Column, symbol: Column, coords: Column, rotation: Column, h_align: Column, v_align: Column, text: Column, pattern_rotation: Column, origin_x: Column, origin_y: Column) -> Column:
    """An object's element. rotation and pattern_rotation: numbers as text (see functions.number); a null rotation isn't
    written."""
    attribute = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))).otherwise("")
    head = F.concat(F.lit("<object"), attribute("type", kind), attribute("symbol", F.when(symbol >= 0, symbol)), attribute("rotation", rotation), attribute("h_align", F.when(kind == 4, h_align)), attribute("v_align", F.when(kind == 4, v_align)), F.lit(">"))
    body = F.concat(F.lit('<coords count="'), F.size(coords).cast("string"), F.lit('">'), coords_text(coords), F.lit("</coords>"))
    pattern = F.concat(F.lit('<pattern rotation="'), pattern_rotation, F.lit('"><coord x="'), M.native(origin_x).cast("string"), F.lit('" y="'), M.native(origin_y).cast("string"), F.lit('"/></pattern>'))
    words = F.concat(F.lit("<text>"), T.xml_escape(text), F.lit("</text>"))
    return F.concat(head, body, F.when(kind == 1, pattern).when(kind == 4, words).otherwise(""), F.lit("</object>"))


def object_xml(o: dict, rotatable: bool) -> str:
    """The same for one object as the reader gives it."""
    out = [f'<object type="{o["kind"]}"']
    if o["symbol_id"] >= 0:
        out.append(f' symbol="{o["symbol_id"]}"')
    if rotatable and o["rotation"]:
        out.append(f' rotation="{qt_number(o["rotation"])}"')
    if o["kind"] == 4:
        out.append(f' h_align="{o["h_align"]}" v_align="{o["v_align"]}"')
    records = "".join(f"{native(x)} {native(y)}{f' {f}' if f else ''};" for x, y, f in o["coords"])
    out.append(f'><coords count="{len(o["coords"])}">{records}</coords>')
    if o["kind"] == 1:
        x, y = o["pattern_origin"]
        out.append(f'<pattern rotation="{qt_number(o["pattern_rotation"])}"><coord x="{native(x)}" y="{native(y)}"/></pattern>')
    elif o["kind"] == 4:
        quoted = escape(o["text"], {'"': "&quot;", "'": "&apos;"})
        out.append(f"<text>{quoted}</text>")
    return "".join([*out, "</object>"])


def map_xml(scale: int, colors: list[str], symbols: list[str], objects: list[dict], rotatable: bool) -> str:
    """A map file of colours and symbols as they were spelled and objects."""
    block = lambda name, items: f'<{name} count="{len(items)}">\n' + "".join(f"{x}\n" for x in items) + f"</{name}>\n"
    drawn = [object_xml(o, rotatable) for o in objects]
    return "".join([
        '<?xml version="1.0" encoding="UTF-8"?>\n', f'<map xmlns="{SPACE}" version="{VERSION}">\n<notes></notes>\n',
        f'<georeferencing scale="{scale}"><projected_crs id="Local"/></georeferencing>\n', block("colors", colors),
        '<barrier version="6" required="0.6.0">\n', block("symbols", symbols), '<parts count="1" current="0">\n<part name="default part">',
        block("objects", drawn).rstrip("\n"), "</part>\n</parts>\n", '<templates count="0" first_front_template="0">\n',
        '<defaults use_meters_per_pixel="true" meters_per_pixel="0" dpi="0" scale="0"/>\n</templates>\n</barrier>\n</map>\n',
    ])
