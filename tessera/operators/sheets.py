"""A map file for each symbol of a map: test objects on a grid."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions.number import qt_number
from tessera.operators.expand import Expander
from tessera.operators.maps import AREA, COMBINED, LINE, POINT, REGISTRATION, TEXT
from tessera.operators.text import draw_text
from tessera.operators.writer import map_xml
from tessera.sources.xmap import Reader, fragments
from tessera.sources.xml import as_int

#: Sizes in metres on the ground, turns, the sample text, gaps and names of symbol types.
SIZES, TURNS, SAMPLE = (5.0, 50.0, 100.0), 8, "Sample 123"
LEAST_GAP, GAP = 2.0, 0.15
NAMES = {POINT: "point", LINE: "line", AREA: "area", TEXT: "text", COMBINED: "combined"}
_KAPPA = 0.5522847498307936

Stroke = list[tuple[str, list[complex]]]


def line(size: float) -> list[Stroke]:
    return [[("M", [-size / 2 + 0j]), ("L", [size / 2 + 0j])]]


def square(size: float) -> list[Stroke]:
    h = size / 2
    corners = [complex(x, y) for x, y in ((-h, -h), (h, -h), (h, h), (-h, h))]
    return [[("M", corners[:1]), *[("L", [c]) for c in corners[1:]], ("Z", [])]]


def circle(size: float) -> list[Stroke]:
    r = size / 2
    quarter = [complex(r, r * _KAPPA), complex(r * _KAPPA, r), complex(0, r)]
    return [[("M", [complex(r, 0)]), *[("C", [z * 1j**k for z in quarter]) for k in range(4)], ("Z", [])]]


def s_curve(size: float) -> list[Stroke]:
    h = size / 2
    return [[("M", [complex(-h / 2, -h)]), ("C", [complex(h, -h), complex(h, 0), 0j]), ("C", [complex(-h, 0), complex(-h, h), complex(h / 2, h)])]]


def zigzag(size: float) -> list[Stroke]:
    h = size / 2
    return [[("M", [complex(-h, h / 2)]), *[("L", [z]) for z in (complex(-h / 3, -h / 2), complex(h / 3, h / 2), complex(h, -h / 2))]]]


def square_with_hole(size: float) -> list[Stroke]:
    return [*square(size), *circle(size / 2)]


def star(size: float) -> list[Stroke]:
    tips = []
    for i in range(10):
        angle, radius = -math.pi / 2 + i * math.pi / 5, size / 2 if i % 2 == 0 else size / 5
        tips.append(complex(radius * math.cos(angle), radius * math.sin(angle)))
    return [[("M", tips[:1]), *[("L", [z]) for z in tips[1:]], ("Z", [])]]


def coords(parts: list[Stroke], mm_per_metre: float) -> list[list]:
    """[x mm, y mm, flags] on whole native units."""

    def mm(z: complex) -> list:
        return [math.floor(v * mm_per_metre * 1000 + 0.5) / 1000 for v in (z.real, z.imag)]

    out: list[list] = []
    for part in parts:
        if out:
            out[-1][2] |= P.HOLE
        begin = len(out)
        for op, points in part:
            if op == "Z":
                if out[-1][:2] == out[begin][:2]:
                    out[-1][2] |= P.CLOSE
                else:
                    out.append([*out[begin][:2], out[begin][2] & ~P.CURVE | P.CLOSE])
                continue
            if op == "C":
                out[-1][2] |= P.CURVE
            out += [[*mm(z), 0] for z in points]
    return out


@dataclass
class Sheet:
    objects: list[dict] = field(default_factory=list)
    cells: list[tuple[int, int, str]] = field(default_factory=list)  # row, column, description
    columns: list[str] = field(default_factory=list)
    rows: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def add(self, obj: dict, column: int, text: str) -> None:
        """Into the last row."""
        self.objects.append(obj)
        self.cells.append((len(self.rows) - 1, column, text))


def _object(kind: int, points: list[list], **more) -> dict:
    return {"kind": kind, "symbol_id": 0, "rotation": 0.0, "coords": points, "pattern_rotation": 0.0, "pattern_origin": [0.0, 0.0], "text": "", "h_align": 0, "v_align": 0, "box": None} | more


@dataclass
class Facts:
    """Of a symbol and all that it is made of."""

    types: int
    turning: bool
    min_length: float
    min_area: int


def tree(symbols: list[dict], ids: dict[int, int], symbol: dict) -> list[dict]:
    """The symbol and all that it is made of, each once; of private parts that are combined only they themselves."""
    found, todo, seen = [], [(symbol, True)], set()
    while todo:
        s, known = todo.pop()
        if id(s) in seen:
            continue
        seen.add(id(s))
        found.append(s)
        if s["type"] == COMBINED and known:
            owned = iter(s["owned"])
            for part in s["part_ids"]:
                if part in ids:
                    todo.append((symbols[ids[part]], True))
                elif part is None and (inner := next(owned, None)) is not None:
                    todo.append((inner, inner["type"] != COMBINED))
    return found


def facts(symbols: list[dict], ids: dict[int, int], symbol: dict) -> Facts:
    found = tree(symbols, ids, symbol)
    types = 0
    for s in found:
        types |= s["type"]
    return Facts(types, any(p["rotatable"] for s in found if s["type"] == AREA for p in s["patterns"]), max([0.0, *[s["minimum_length"] for s in found if s["type"] == LINE]]), max([0, *[s["minimum_area"] for s in found if s["type"] == AREA]]))


def make_sheet(symbol: dict, known: Facts, mm_per_metre: float) -> Sheet:
    out = Sheet()
    path = lambda shape, size, **more: _object(1, coords(shape(size), mm_per_metre), **more)
    degrees = [i * 360 // TURNS for i in range(TURNS)]
    turn = [i * 2 * math.pi / TURNS for i in range(TURNS)]

    def sized(label: str, shape, **more) -> None:
        out.rows.append(label)
        for column, size in enumerate(SIZES):
            out.add(path(shape, size, **more), column, f"{label}, {qt_number(size)} m")

    def least(label: str, what: str, shape, sizes: list[float]) -> None:
        out.rows.append(label)
        for column, (factor, size) in enumerate(zip((50, 150), sizes, strict=True)):
            out.add(path(shape, size), column, f"{what}, {factor}% of the {label.split(' (')[0]}")

    def lines() -> None:
        for label, shape in (("straight line", line), ("square, closed, polygonal", square), ("circle, closed, bezier", circle), ("S curve, open, bezier", s_curve), ("zigzag, open, sharp corners", zigzag)):
            sized(label, shape)
        if known.min_length > 0:
            m = known.min_length / mm_per_metre
            least(f"minimum length ({qt_number(m, 3)} m)", "straight line", line, [0.5 * m, 1.5 * m])
            out.notes.append("Lines shorter than the minimum length are drawn all the same.")

    def areas() -> None:
        for label, shape, turns in (("square, polygonal", square, True), ("circle, bezier", circle, True), ("square with a hole", square_with_hole, False), ("five-pointed star", star, False)):
            for i in range(TURNS if turns and known.turning else 1):
                if turns and known.turning:
                    sized(f"{label}, pattern {degrees[i]} deg", shape, rotation=turn[i], pattern_rotation=turn[i])
                else:
                    sized(label, shape)
        if not known.turning:
            out.notes.append("No fill pattern of this symbol can be turned, so each shape stands once.")
        if known.min_area > 0:
            m2 = 0.001 * known.min_area / mm_per_metre**2
            least(f"minimum area ({qt_number(m2, 3)} m2)", "square", square, [math.sqrt(0.5 * m2), math.sqrt(1.5 * m2)])
            out.notes.append("Areas smaller than the minimum area are drawn all the same.")

    if symbol["type"] in (POINT, TEXT):
        out.columns.append("nominal size")
        turns = symbol["type"] == TEXT or symbol["is_rotatable"]
        for i in range(TURNS if turns else 1):
            label = f"rotated {degrees[i]} deg" if turns else "unrotated"
            out.rows.append(label)
            words = {"text": SAMPLE, "h_align": 1, "v_align": 2} if symbol["type"] == TEXT else {}
            out.add(_object(4 if words else 0, [[0.0, 0.0, 0]], rotation=turn[i], **words), 0, label)
        if not turns:
            out.notes.append("This point symbol can't be turned, so it stands once.")
        return out
    out.columns = [f"{qt_number(s)} m" for s in SIZES]
    if known.types & LINE or not known.types & AREA:
        lines()
    if known.types & AREA:
        areas()
    return out


def lay_out(sheet: Sheet, boxes: list[P.Box | None]) -> None:
    """Move each object, by whole native units, so that its extent's middle is its cell's."""
    boxes = [b or (0.0, 0.0, 0.0, 0.0) for b in boxes]
    starts = []
    for axis in (0, 1):  # columns, then rows
        sizes: dict[int, float] = {}
        for cell, b in zip(sheet.cells, boxes, strict=True):
            k = cell[1 - axis]
            sizes[k] = max(sizes.get(k, 0.0), b[2 + axis] - b[axis])
        gap = max(LEAST_GAP, GAP * max(sizes.values(), default=0.0))
        at, middles = 0.0, {}
        for k in range(max(sizes, default=-1) + 1):
            middles[k] = at + sizes.get(k, 0.0) / 2
            at += sizes.get(k, 0.0) + gap
        starts.append(middles)
    for (row, column, _), b, o in zip(sheet.cells, boxes, sheet.objects, strict=True):
        dx = math.floor((starts[0][column] - (b[0] + b[2]) / 2) * 1000 + 0.5) / 1000
        dy = math.floor((starts[1][row] - (b[1] + b[3]) / 2) * 1000 + 0.5) / 1000
        o["coords"] = [[x + dx, y + dy, f] for x, y, f in o["coords"]]


def number_text(code: str) -> str:
    """Up to three numbers of a code joined by dots."""
    out = []
    for part in re.findall(r"(?s)(.[^.]*)(?:\.|$)", code)[:3]:
        n = as_int(part, 0)
        if n < 0:
            break
        out.append(str(n))
    return ".".join(out)


def plain_text(name: str) -> str:
    if "<" not in name:
        return name
    name = re.sub(r"<[^>]*(>|$)|>", "", name)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        name = name.replace(entity, char)
    return name


def base_name(index: int, symbol: dict) -> str:
    safe = lambda t: "".join(c if c.isalnum() or c in "-." else "_" for c in t)
    return f"{index + 1:03d}_{NAMES[symbol['type']]}_{safe(number_text(symbol['code']))}_{safe(plain_text(symbol['name']))}"


def description(sheet: Sheet, symbol: dict, source: str, scale: int) -> str:
    listed = lambda title, letter, items: [f"{title}:", *[f"  {letter}{i}: {x}" for i, x in enumerate(items, 1)], ""]
    out = [f"Symbol:      {number_text(symbol['code'])} {plain_text(symbol['name'])}", f"Type:        {NAMES[symbol['type']]}", f"Source map:  {source}", f"Map scale:   1:{scale}", ""]
    out += ["A grid of objects: rows from the top, columns from the left, sizes in metres on the ground.", ""]
    out += listed("Columns (left to right)", "c", sheet.columns) + listed("Rows (top to bottom)", "r", sheet.rows)
    out += ["Cells:", *[f"  r{r + 1}c{c + 1}: {text}" for r, c, text in sheet.cells]]
    if sheet.notes:
        out += ["", "Notes:", *[f"  - {n}" for n in sheet.notes]]
    return "\n".join(out) + "\n"


_PART = '<part symbol="'


def part_references(text: str) -> list[int]:
    return [n for x in re.findall(r'<part symbol="([^"]*)', text) if (n := as_int(x if x == x.strip() else None, -(2**31))) != -(2**31)]


def wanted(spelled: dict[int, str], first: int) -> list[int]:
    """Ids of all symbols that one is made of, in their order; a symbol that isn't there is left out."""
    found, todo = {first}, [first]
    while todo:
        new = {p for p in part_references(spelled.get(todo.pop(), "")) if p in spelled} - found
        found |= new
        todo += new
    return sorted(found)


def renumbered(text: str, new_id: int, mapping: dict[int, int]) -> str:
    """A symbol as it was spelled, with another id and its parts' ids mapped."""
    cut = text.find(">") + 1 or len(text)
    head, tail = text[:cut], text[cut:]
    head = re.sub(r' id="[^"]*', f' id="{new_id}', head, count=1) if ' id="' in head else head.replace("<symbol", f'<symbol id="{new_id}"', 1)
    return head + re.sub(r'<part symbol="([^"]*)', lambda m: f"{_PART}{mapping.get(as_int(m[1], -1), as_int(m[1], -1))}", tail)


@lru_cache(maxsize=2)
def _read(data: bytes) -> tuple[Reader, dict, dict[int, int]]:
    reader, spelled = Reader(data), fragments(data)
    ids = {s["file_id"]: i for i, s in enumerate(reader.symbols) if s["file_id"] >= 0}
    first: dict[int, str] = {}
    for n, t in spelled["symbol"]:
        first.setdefault(n, t.decode("utf-8", "replace"))
    return reader, {"color": [t.decode("utf-8", "replace") for _, t in spelled["color"]], "symbol": first}, ids


def leaves(symbols: list[dict], ids: dict[int, int], symbol: dict) -> list[dict]:
    """What a symbol draws with, in order: hidden parts and helpers draw nothing, nor does a symbol inside itself."""
    found: list[dict] = []
    todo: list[tuple[dict, bool, tuple[int, ...]]] = [(symbol, True, ())]
    while todo:
        s, known, above = todo.pop()
        if s["type"] != COMBINED:
            found.append(s)
        elif known and id(s) not in above:
            owned = iter(s["owned"])
            inner = [(next(owned, None), False) if part is None else (symbols[ids[part]] if part in ids else None, True) for part in s["part_ids"]]
            shown = [(x, shared, (*above, id(s))) for x, shared in inner if x is not None and not x["is_hidden"] and not x["is_helper"]]
            todo += reversed(shown)
    return found


def build(data: bytes, index: int, source: str) -> tuple[str, str, str] | None:
    """Name, map file and description of one symbol's sheet; None if it has no cells. ValueError if the symbol can't be
    found as it was spelled."""
    reader, spelled, ids = _read(data)
    symbol = reader.symbols[index]
    sheet = make_sheet(symbol, facts(reader.symbols, ids, symbol), 1000.0 / reader.scale)
    if not sheet.cells:
        return None
    colors = frozenset([*range(len(reader.colors)), REGISTRATION])
    boxes = []
    for o in sheet.objects:
        e = Expander(colors, draw_text)
        for s in leaves(reader.symbols, ids, symbol):
            e.draw(s, o)
        boxes.append(e.extent)
    lay_out(sheet, boxes)
    every = wanted(spelled["symbol"], symbol["file_id"])
    mapping = {old: new for new, old in enumerate(every)}
    texts = [renumbered(spelled["symbol"][old], new, mapping) for new, old in enumerate(o for o in every if o in spelled["symbol"])]
    name = base_name(index, symbol)
    if not texts:
        raise ValueError(f"{source}: symbol {name} isn't in the file as it was read")
    for o in sheet.objects:
        o["symbol_id"] = mapping.get(symbol["file_id"], 0)
    return name, map_xml(reader.scale, spelled["color"], texts, sheet.objects, symbol["is_rotatable"]), description(sheet, symbol, source, reader.scale)


def create_maps(files: DataFrame) -> DataFrame:
    """map_id, symbol, name, map, description for each symbol of files(map_id, content). Symbols are dealt over the
    tasks; a task reads its file once."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(m, i, c) for m, c in zip(b.map_id, b.content, strict=True) for i in range(len(_read(bytes(c))[0].symbols))], columns=["map_id", "symbol", "content"])

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(m, i, *got) for m, i, c in zip(b.map_id, b.symbol, b.content, strict=True) if (got := build(bytes(c), int(i), m.rpartition("/")[2]))]
            yield pd.DataFrame(rows, columns=["map_id", "symbol", "name", "map", "description"])

    listed = files.select("map_id", "content").mapInPandas(counted, "map_id string, symbol int, content binary")
    return listed.repartition("map_id", F.floor(F.col("symbol") / 16)).mapInPandas(made, "map_id string, symbol int, name string, map string, description string")
