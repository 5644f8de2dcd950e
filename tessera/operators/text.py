"""Text objects: lines, alignment, framing and the line below, as outlines.

Lines are set at a size of 256 units and then scaled. Kerning is the face's own pair table; other shaping rules of
fonts are not applied.
"""

from __future__ import annotations

import cmath
from dataclasses import dataclass

from tessera.functions import paths as P
from tessera.functions.font import Font, face

SIZE = 256.0
#: Alignments.
LEFT, CENTER, RIGHT = 0, 1, 2
BASELINE, TOP, MIDDLE, BOTTOM = 0, 1, 2, 3


def advances(font: Font, line: str, kerning: bool) -> list[tuple[int, float]]:
    """Glyphs and advances of a line."""
    glyphs = [font.glyph(c) for c in line]
    pairs = font.pairs if kerning else {}
    scale = SIZE / font.units
    return [(g, (font.advance(g) + pairs.get((g, after), 0)) * scale) for g, after in zip(glyphs, [*glyphs[1:], -1], strict=True)]


@dataclass
class Layout:
    text: P.Outline
    below: P.Outline


def lay_out(font: Font, symbol: dict, obj: dict) -> Layout:
    """A text in units of SIZE around its point: each line feed begins a paragraph; nothing is wrapped."""
    scale, unit = SIZE / font.units, SIZE / symbol["font_size"]
    ascent = font.ascender * scale
    spacing = symbol["line_spacing"] * (font.ascender - font.descender + font.gap) * scale
    extra = symbol["paragraph_spacing"] + (symbol["line_below_distance"] + symbol["line_below_width"] if symbol["line_below"] else 0.0)
    step = spacing + extra * unit
    letter = font.advance(font.glyph(" ")) * scale * symbol["character_spacing"]
    lines = obj["text"].split("\n")
    height = ascent + (len(lines) - 1) * step
    w, h = (v * unit for v in obj["box"]) if obj["box"] else (0.0, 0.0)
    y = 0.0 if obj["v_align"] == BASELINE else ascent
    y += {MIDDLE: -height / 2, BOTTOM: -height + h / 2}.get(obj["v_align"], 0.0)
    if obj["v_align"] in (BASELINE, TOP):
        y -= h / 2
    text, below = P.Outline(), P.Outline()
    for line in lines:
        glyphs = advances(font, line, symbol["kerning"])
        width = sum(a + letter for _, a in glyphs)
        x = {CENTER: -width / 2, RIGHT: w / 2 - width}.get(obj["h_align"], -w / 2)
        at = x
        for glyph, advance in glyphs:
            for points, ops in font.outline(glyph):
                text.subpaths.append(_cubics([complex(at + z.real * scale, y - z.imag * scale) for z in points], ops))
            at += advance + letter
        if symbol["line_below"] and symbol["line_below_width"] > 0:
            top = y + symbol["line_below_distance"] * unit
            bottom = top + symbol["line_below_width"] * unit
            below.subpaths.append(([complex(x, top), complex(x + width, top), complex(x + width, bottom), complex(x, bottom)], "LLL", True))
        y += step
    return Layout(text, below)


def _cubics(points: list[complex], ops: str) -> tuple[list[complex], str, bool]:
    out, at = [points[0]], 1
    for op in ops:
        if op == "Q":
            q, end = points[at], points[at + 1]
            out += [out[-1] + (q - out[-1]) * (2 / 3), end + (q - end) * (2 / 3), end]
            at += 2
        else:
            out.append(points[at])
            at += 1
    return out, ops.replace("Q", "C"), True


def moved(outline: P.Outline, turn: complex, at: complex) -> P.Outline:
    return P.Outline([([z * turn + at for z in points], ops, closed) for points, ops, closed in outline.subpaths])


def draw_text(expander, symbol: dict, obj: dict) -> None:
    """Framing first, then the glyphs, then the line below. An object's rotation turns its text whatever its symbol
    says."""
    if not obj["coords"] or not obj["text"] or symbol["font_size"] <= 0:
        return
    font = face(symbol["font_family"], symbol["bold"], symbol["italic"])
    if font is None or font.units <= 0:
        return
    made = lay_out(font, symbol, obj)
    x, y, _ = obj["coords"][0]
    at = complex(x, y)
    turn = cmath.rect(symbol["font_size"] / SIZE, -obj["rotation"])
    text = moved(made.text, turn, at)
    box = _turned_box(made.text, turn, at)
    color = symbol["framing_color"]
    if symbol["framing"]:
        half = symbol["framing_line_half_width"]
        if symbol["framing_mode"] == 1 and half > 0:
            wide = None if box is None else (box[0] - half, box[1] - half, box[2] + half, box[3] + half)
            expander.stroke(text, color, 2 * half, "round", "round", wide)
        elif symbol["framing_mode"] == 2:
            shift = complex(symbol["framing_shadow_x_offset"], symbol["framing_shadow_y_offset"]) * cmath.rect(1.0, -obj["rotation"])
            expander.fill(moved(text, 1, shift), color, _turned_box(made.text, turn, at + shift), "winding")
    expander.fill(text, symbol["color"], box, "winding")
    expander.fill(moved(made.below, turn, at), symbol["line_below_color"])


def _turned_box(outline: P.Outline, turn: complex, at: complex) -> P.Box | None:
    """The box of the outline's own box, turned."""
    box = outline.box()
    if box is None:
        return None
    return P.box_of([complex(u, v) * turn + at for u in (box[0], box[2]) for v in (box[1], box[3])])
