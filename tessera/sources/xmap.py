"""Map files as tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.maps import AREA, COMBINED, LINE, POINT, TEXT
from tessera.sources.xml import Element, parse

#: The newest version known, the scale of a map that names none, and which element a symbol type reads.
NEWEST, SCALE = 9, 15_000
SHAPES = {POINT: "point_symbol", LINE: "line_symbol", AREA: "area_symbol", TEXT: "text_symbol", COMBINED: "combined_symbol"}
NOT_A_MAP = "The file is not a map."
_RECORD = re.compile(r"\s*([+-]?[0-9]+)\s+([+-]?[0-9]+)(?![^\s;])(?:\s+([^\s;]+))?[\s;]*")

BORDER = {"color": -1, "width": 0.0, "shift": 0.0, "dashed": False, "dash_length": 2.0, "break_length": 1.0}


def coordinates(text: str) -> list[list]:
    """[x mm, y mm, flags] of "x y[ flags];" records, up to the first bad one."""
    out, at = [], 0
    while m := _RECORD.match(text, at):
        x, y, f = int(m[1]), int(m[2]), m[3]
        if not all(-(2**31) <= v < 2**31 for v in (x, y)):
            break
        flags = int(f) if f and re.fullmatch(r"[+-]?[0-9]+", f) and -(2**31) <= int(f) < 2**31 else 0
        out.append([0.001 * x, 0.001 * y, flags])
        at = m.end()
    return out


class Reader:
    """One file's rows. Symbols are dicts; nested ones stand in their place."""

    def __init__(self, data: bytes):
        self.warnings: list[str] = []
        self.colors: list[dict] = []
        self.symbols: list[dict] = []
        self.objects: list[dict] = []
        self.scale = SCALE
        root = parse(data)
        if root is None or root.name != "map":
            raise ValueError(NOT_A_MAP)
        self.version = root.int("version", 0)
        if self.version > NEWEST:
            self.warnings.append("The file was written by a newer version of Mapper.")
        for e in root.through_barriers():
            if e.name == "georeferencing" and e.int("scale") > 0:
                self.scale = e.int("scale")
            elif e.name == "colors":
                for x in e.through_barriers():
                    if x.name == "color":
                        self._color(x)
            elif e.name == "symbols":
                for x in e.through_barriers():
                    if x.name == "symbol" and (s := self.symbol(x)):
                        self.symbols.append(s | {"file_id": x.int("id", -1)})
            elif e.name == "parts":
                for part in e.through_barriers():
                    for group in part.through_barriers() if part.name == "part" else ():
                        for x in group.through_barriers() if group.name == "objects" else ():
                            if x.name == "object" and (o := self.object(x)):
                                self.objects.append(o)

    def _color(self, e: Element) -> None:
        rgb, from_rgb = (0.0, 0.0, 0.0), False
        for x in e.children:
            if x.name == "rgb":
                rgb = tuple(float(np.float32(x.float(c))) for c in "rgb")
            elif x.name == "cmyk":
                from_rgb = x.get("method") == "rgb"
        if (e.has("c") or e.has("k")) and not from_rgb:
            k, one = np.float32(e.float("k")), np.float32(1)
            rgb = tuple(float(one - (np.float32(e.float(c)) * (one - k) + k)) for c in "cmy")
        color = {"name": e.get("name") or "", "r": rgb[0], "g": rgb[1], "b": rgb[2], "opacity": e.float("opacity", 1.0)}
        at = e.int("priority", -1)
        if at < 0:
            self.colors.append(color)
            return
        while at >= len(self.colors):
            self.colors.append({"name": "", "r": 0.0, "g": 0.0, "b": 0.0, "opacity": 1.0})
        self.colors[at] = color

    def symbol(self, e: Element) -> dict | None:
        kind = e.int("type")
        if kind not in SHAPES:
            self.warnings.append(f"Skipping a symbol of unknown type {kind}.")
            return None
        out = {"type": kind, "name": e.get("name") or "", "code": e.get("code") or "", "is_hidden": e.flag("is_hidden"), "is_helper": e.flag("is_helper_symbol"), "is_rotatable": False}
        read = {POINT: self._point, LINE: self._line, AREA: self._area, TEXT: self._text, COMBINED: self._combined}[kind]
        out |= read(Element(SHAPES[kind], [], 0))  # the values of a symbol without a body
        if kind == LINE:
            out["join_style"] = 1
        if kind == TEXT:
            out["is_rotatable"] = False
        for x in e.children:
            if x.name == SHAPES[kind]:
                out |= read(x)
        return out

    def _nested_point(self, e: Element) -> dict | None:
        """The first point symbol inside."""
        for x in e.children:
            if x.name == "symbol" and (s := self.symbol(x)) and s["type"] == POINT:
                return s
        return None

    def _point(self, e: Element) -> dict:
        elements = []
        for x in e.children:
            symbol = obj = None
            for y in x.children if x.name == "element" else ():
                if y.name == "symbol" and symbol is None:
                    symbol = self.symbol(y)
                elif y.name == "object" and symbol is not None:
                    obj = self.object(y)
            if symbol and obj:
                elements.append({"symbol": symbol, "object": obj})
        return {"is_rotatable": e.flag("rotatable"), "inner_radius": e.mm("inner_radius"), "inner_color": e.int("inner_color", -1), "outer_width": e.mm("outer_width"), "outer_color": e.int("outer_color", -1), "elements": elements}

    def _line(self, e: Element) -> dict:
        out = {"color": e.int("color", -1), "cap_style": e.int("cap_style"), "join_style": e.int("join_style")}
        out |= {k: e.mm(k) for k in ("line_width", "minimum_length", "segment_length", "end_length", "dash_length", "break_length", "in_group_break_length", "mid_symbol_distance")}
        out |= {k: e.flag(k) for k in ("dashed", "show_at_least_one_symbol", "half_outer_dashes", "suppress_dash_symbol_at_ends")}
        out |= {"dashes_in_group": max(1, e.int("dashes_in_group", 1)), "mid_symbols_per_spot": e.int("mid_symbols_per_spot", 1), "mid_symbol_placement": e.int("mid_symbol_placement"), "scale_dash_symbol": e.get("scale_dash_symbol") != "false"}
        given = e.has("start_offset") or e.has("end_offset")
        tip = e.mm("pointed_cap_length") if out["cap_style"] == 3 else 0.0
        out |= {"start_offset": e.mm("start_offset") if given else tip, "end_offset": e.mm("end_offset") if given else tip}
        out |= {"start_symbol": None, "mid_symbol": None, "end_symbol": None, "dash_symbol": None, "border": dict(BORDER), "right_border": dict(BORDER)}
        for x in e.children:
            if x.name in ("start_symbol", "mid_symbol", "end_symbol", "dash_symbol"):
                out[x.name] = self._nested_point(x)
            elif x.name == "borders":
                found = [self._border(y) if y.name == "border" else None for y in x.children]
                for key, b in zip(("border", "right_border"), found, strict=False):
                    out[key] = b or out[key]
                if len(found) == 1:
                    out["right_border"] = out["border"]
        return out

    @staticmethod
    def _border(e: Element) -> dict:
        dashed = e.flag("dashed")
        lengths = {"dash_length": e.mm("dash_length", 2.0), "break_length": e.mm("break_length", 1.0)} if dashed else {}
        return BORDER | {"color": e.int("color", -1), "width": e.mm("width"), "shift": e.mm("shift"), "dashed": dashed} | lengths

    def _area(self, e: Element) -> dict:
        patterns = []
        for x in e.children:
            if x.name == "pattern":
                lengths = {k: x.mm(k) for k in ("line_spacing", "line_offset", "offset_along_line", "line_width", "point_distance")}
                patterns.append({"type": x.int("type", 1), "no_clipping": x.int("no_clipping") & 3, "angle": float(np.float32(x.float("angle"))), "rotatable": x.flag("rotatable"), "line_color": x.int("color", -1), "point": self._nested_point(x)} | lengths)
        return {"is_rotatable": e.flag("rotatable"), "color": e.int("inner_color", -1), "minimum_area": e.int("min_area"), "patterns": patterns}

    def _text(self, e: Element) -> dict:
        out = {"is_rotatable": e.flag("rotatable") if e.has("rotatable") else self.version < NEWEST, "font_family": "", "font_size": 4.0, "bold": False, "italic": False, "color": -1, "line_spacing": 1.0, "paragraph_spacing": 0.0, "character_spacing": 0.0, "kerning": False, "framing": False, "framing_color": -1, "framing_mode": 0, "framing_line_half_width": 0.0, "framing_shadow_x_offset": 0.0, "framing_shadow_y_offset": 0.0, "line_below": False, "line_below_color": -1, "line_below_width": 0.0, "line_below_distance": 0.0}
        for x in e.children:
            if x.name == "font":
                out |= {"font_family": x.get("family") or "", "font_size": x.mm("size", 4.0), "bold": x.flag("bold"), "italic": x.flag("italic")}
            elif x.name == "text":
                out |= {"color": x.int("color", -1), "line_spacing": x.float("line_spacing", 1.0), "paragraph_spacing": x.mm("paragraph_spacing"), "character_spacing": x.float("character_spacing"), "kerning": x.flag("kerning")}
            elif x.name == "framing":
                out |= {"framing": True, "framing_color": x.int("color", -1), "framing_mode": x.int("mode")} | {f"framing_{k}": x.mm(k) for k in ("line_half_width", "shadow_x_offset", "shadow_y_offset")}
            elif x.name == "line_below":
                out |= {"line_below": True, "line_below_color": x.int("color", -1), "line_below_width": x.mm("width"), "line_below_distance": x.mm("distance")}
        return out

    def _combined(self, e: Element) -> dict:
        ids, owned = [], []
        for x in e.children:
            if x.name == "part":
                private = x.flag("private")
                ids.append(None if private else x.int("symbol", -1))
                owned += [s for y in x.children if private and y.name == "symbol" and (s := self.symbol(y))]
        return {"part_ids": ids, "owned": owned}

    def object(self, e: Element) -> dict | None:
        kind = e.int("type")
        if kind not in (0, 1, 4):
            self.warnings.append(f"Skipping an object of unknown type {kind}.")
            return None
        out = {"kind": kind, "symbol_id": e.int("symbol", -1), "rotation": e.float("rotation"), "coords": [], "pattern_rotation": 0.0, "pattern_origin": [0.0, 0.0], "text": "", "h_align": e.int("h_align"), "v_align": e.int("v_align"), "box": None}
        for x in e.children:
            if x.name == "coords":
                out["coords"] = []
                for y in x.items:
                    if isinstance(y, str):
                        out["coords"] += coordinates(y)
                    elif y.name == "coord":
                        out["coords"].append([y.mm("x"), y.mm("y"), y.int("flags")])
            elif x.name == "text" and kind == 4:
                out["text"] = x.text
            elif x.name == "pattern" and kind == 1:
                out["pattern_rotation"] = x.float("rotation")
                for y in x.children:
                    if y.name == "coord":
                        out["pattern_origin"] = [y.mm("x"), y.mm("y")]
        if kind == 4 and len(out["coords"]) > 1:
            out["box"] = out["coords"][1][:2]
            del out["coords"][1:]
        return out

    def rows(self) -> Iterator[tuple[str, int, dict]]:
        """(table, seq, row). A combined symbol's private parts are symbols behind the map's own; parts name symbols by
        id or, private ones, by seq: the n-th private part is the n-th that could be read."""
        yield "maps", 0, {"version": self.version, "scale_denominator": self.scale, "error": None}
        for i, c in enumerate(self.colors):
            yield "colors", i, {"priority": i} | c
        private = len(self.symbols)
        for i, s in enumerate(self.symbols):
            if s["type"] == COMBINED:
                owned = list(range(private, private + len(s["owned"])))
                private += len(owned)
                for at, inner in zip(owned, s["owned"], strict=True):
                    yield "symbols", at, _symbol_row(inner | {"file_id": -1}, i)
                left = iter(owned)
                for k, part_id in enumerate(s["part_ids"]):
                    yield "parts", i * 1000 + k, {"parent": i, "part_seq": k, "part_id": part_id, "is_private": part_id is None, "own": next(left, None) if part_id is None else None}
            yield "symbols", i, _symbol_row(s, None)
        for i, o in enumerate(self.objects):
            yield "objects", i, {"object_seq": i, "kind": o["kind"], "symbol_id": o["symbol_id"], "rotation": o["rotation"], "n_coords": len(o["coords"]), "body": json.dumps(o)}
        for i, w in enumerate(self.warnings):
            yield "warnings", i, {"seq": i, "message": w}


def _symbol_row(s: dict, parent: int | None) -> dict:
    turning = s["type"] == AREA and any(p["rotatable"] for p in s["patterns"])
    return {"file_id": s["file_id"], "symbol_type": s["type"], "code": s["code"], "name": s["name"], "is_hidden": s["is_hidden"], "is_helper": s["is_helper"], "is_rotatable": s["is_rotatable"], "turning_pattern": turning, "minimum_length": s.get("minimum_length", 0.0), "minimum_area": s.get("minimum_area", 0), "parent": parent, "body": json.dumps(s)}


SCHEMAS = {
    "maps": "version int, scale_denominator int, error string",
    "colors": "priority int, name string, r float, g float, b float, opacity double",
    "symbols": "file_id int, symbol_type int, code string, name string, is_hidden boolean, is_helper boolean, is_rotatable boolean, turning_pattern boolean, minimum_length double, minimum_area int, parent int, body string",
    "parts": "parent int, part_seq int, part_id int, is_private boolean, own int",
    "objects": "object_seq int, kind int, symbol_id int, rotation double, n_coords int, body string",
    "warnings": "seq int, message string",
}
_COORDS = "struct<coords:array<array<double>>,pattern_rotation:double,pattern_origin:array<double>,text:string,h_align:int,v_align:int,box:array<double>>"


@dataclass
class MapTables:
    """A parsed set of map files: one row a table row, from which each table is selected."""

    rows: DataFrame

    def table(self, name: str) -> DataFrame:
        """map_id, seq and the table's columns."""
        own = [F.col("seq")] if name == "symbols" else []
        return self.rows.filter(F.col("kind") == name).select("map_id", *own, F.from_json("row", SCHEMAS[name]).alias("r")).select("map_id", *own, "r.*")

    @cached_property
    def maps(self) -> DataFrame:
        return self.table("maps")

    @cached_property
    def colors(self) -> DataFrame:
        return self.table("colors")

    @cached_property
    def symbols(self) -> DataFrame:
        return self.table("symbols")

    @cached_property
    def parts(self) -> DataFrame:
        return self.table("parts")

    @cached_property
    def objects(self) -> DataFrame:
        return self.table("objects")

    @cached_property
    def warnings(self) -> DataFrame:
        return self.table("warnings")

    @cached_property
    def coords(self) -> DataFrame:
        """map_id, object_seq, i, x, y, flags."""
        inner = self.objects.select("map_id", "object_seq", F.from_json("body", _COORDS).alias("o"))
        return inner.select("map_id", "object_seq", F.posexplode("o.coords").alias("i", "c")).select("map_id", "object_seq", "i", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"), F.col("c")[2].cast("int").alias("flags"))


def _parsed(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            try:
                rows = [*Reader(data.as_py()).rows()]
            except ValueError as e:
                rows = [("maps", 0, {"version": None, "scale_denominator": None, "error": str(e)})]
            kinds, seqs, values = zip(*rows, strict=True)
            for at in range(0, len(rows), 4096):
                part = slice(at, at + 4096)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(kinds[part])), pa.array(kinds[part]), pa.array(seqs[part], pa.int32()), pa.array([json.dumps(v) for v in values[part]])], ["map_id", "kind", "seq", "row"])


def parse_maps(files: DataFrame) -> MapTables:
    """Tables of files(map_id string, content binary). Files are parsed where they are read, once: the rows are kept."""
    rows = files.select("map_id", "content").mapInArrow(_parsed, "map_id string, kind string, seq int, row string")
    return MapTables(rows.persist())


def read_maps(spark: SparkSession, *paths: str) -> MapTables:
    """Tables of the .omap and .xmap files at paths; folders are read with what is below them. map_id is the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{omap,xmap}").option("recursiveFileLookup", "true").load([*paths])
    return parse_maps(files.select(F.col("path").alias("map_id"), "content"))


def fragments(data: bytes) -> dict[str, list[tuple[int, bytes]]]:
    """Colour and symbol elements of a file exactly as it spells them, with their ids; kinds are color and symbol."""
    root = parse(data)
    if root is None or root.name != "map":
        raise ValueError(NOT_A_MAP)
    out: dict[str, list[tuple[int, bytes]]] = {"color": [], "symbol": []}
    for e in root.through_barriers():
        kind = {"colors": "color", "symbols": "symbol"}.get(e.name)
        for x in e.through_barriers() if kind else ():
            if x.name == kind:
                out[kind].append((x.int("id" if kind == "symbol" else "priority", -1), data[x.begin : x.end]))
    return out


def read_fragments(files: DataFrame) -> DataFrame:
    """map_id, kind, seq, id, text of files(map_id, content)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(path, kind, i, n, t.decode("utf-8", "replace")) for kind, found in fragments(data.as_py()).items() for i, (n, t) in enumerate(found)]
                cols = [*zip(*rows, strict=True)] if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["map_id", "kind", "seq", "id", "text"])

    return files.select("map_id", "content").mapInArrow(run, "map_id string, kind string, seq int, id int, text string")
