"""TrueType fonts: finding a face on the machine, metrics, glyph outlines and pair kerning."""

from __future__ import annotations

import os
import struct
import subprocess
from functools import lru_cache
from pathlib import Path

#: Where fonts are installed, and the families that stand for generic names where nothing else is found.
FOLDERS = ("/usr/share/fonts", "/usr/local/share/fonts", str(Path.home() / ".fonts"), str(Path.home() / ".local/share/fonts"))
GENERIC = {"serif": "DejaVu Serif", "sans-serif": "DejaVu Sans", "sans serif": "DejaVu Sans", "monospace": "DejaVu Sans Mono"}

Contour = tuple[list[complex], str]


class Font:
    """A face of quadratic outlines. Lengths are in font units, y up."""

    def __init__(self, data: bytes):
        self.data = data
        if data[:4] == b"ttcf":
            (start,) = struct.unpack_from(">I", data, 12)
        else:
            start = 0
        (n,) = struct.unpack_from(">H", data, start + 4)
        self.tables = {}
        for i in range(n):
            tag, _, offset, length = struct.unpack_from(">4sIII", data, start + 12 + 16 * i)
            self.tables[tag.decode("latin-1")] = (offset, length)
        if not {"head", "hhea", "hmtx", "maxp", "cmap", "loca", "glyf"} <= self.tables.keys():
            raise ValueError("not a TrueType face with outlines")
        self.units = self._u16("head", 18)
        self.long = self._u16("head", 50)
        self.ascender, self.descender, self.gap = struct.unpack_from(">hhh", data, self.tables["hhea"][0] + 4)
        self.n_metrics = self._u16("hhea", 34)
        self.n_glyphs = self._u16("maxp", 4)
        self.map = self._characters()
        self.pairs = self._kerning()

    def _u16(self, table: str, at: int) -> int:
        return struct.unpack_from(">H", self.data, self.tables[table][0] + at)[0]

    def _characters(self) -> dict[int, int]:
        base, out = self.tables["cmap"][0], {}
        found = {}
        for i in range(self._u16("cmap", 2)):
            platform, encoding, offset = struct.unpack_from(">HHI", self.data, base + 4 + 8 * i)
            if (platform, encoding) in ((3, 10), (0, 4), (0, 6), (3, 1), (0, 3), (0, 1), (0, 0), (3, 0)):
                found[struct.unpack_from(">H", self.data, base + offset)[0]] = base + offset
        if at := found.get(12):
            (n,) = struct.unpack_from(">I", self.data, at + 12)
            for i in range(n):
                first, last, glyph = struct.unpack_from(">III", self.data, at + 16 + 12 * i)
                out.update((c, glyph + c - first) for c in range(first, last + 1))
        elif at := found.get(4):
            n = struct.unpack_from(">H", self.data, at + 6)[0] // 2
            part = lambda k, kind="H": struct.unpack_from(f">{n}{kind}", self.data, at + 14 + k)
            ends, starts, deltas, ranges = part(0), part(2 * n + 2), part(4 * n + 2, "h"), part(6 * n + 2)
            for i, (low, high, delta, shift) in enumerate(zip(starts, ends, deltas, ranges, strict=True)):
                for c in range(low, high + 1):
                    if c == 0xFFFF:
                        continue
                    glyph = c
                    if shift:
                        (glyph,) = struct.unpack_from(">H", self.data, at + 16 + 6 * n + 2 * i - 0 + shift + 2 * (c - low))
                        if not glyph:
                            continue
                    out[c] = (glyph + delta) & 0xFFFF
        return out

    def _kerning(self) -> dict[tuple[int, int], int]:
        out: dict[tuple[int, int], int] = {}
        if "kern" not in self.tables:
            return out
        at = self.tables["kern"][0]
        version, n = struct.unpack_from(">HH", self.data, at)
        if version:
            return out
        at += 4
        for _ in range(n):
            _, length, cover = struct.unpack_from(">HHH", self.data, at)
            if cover >> 8 == 0 and cover & 1 and not cover & 6:
                (pairs,) = struct.unpack_from(">H", self.data, at + 6)
                for i in range(pairs):
                    a, b, value = struct.unpack_from(">HHh", self.data, at + 14 + 6 * i)
                    out[a, b] = out.get((a, b), 0) + value
            at += length
        return out

    def glyph(self, char: str) -> int:
        return self.map.get(ord(char), 0)

    def advance(self, glyph: int) -> int:
        return struct.unpack_from(">H", self.data, self.tables["hmtx"][0] + 4 * min(glyph, self.n_metrics - 1))[0]

    def _place(self, glyph: int) -> tuple[int, int]:
        at = self.tables["loca"][0]
        a, b = struct.unpack_from(">II", self.data, at + 4 * glyph) if self.long else (2 * x for x in struct.unpack_from(">HH", self.data, at + 2 * glyph))
        return self.tables["glyf"][0] + a, b - a

    def outline(self, glyph: int, depth: int = 0) -> list[Contour]:
        """Closed contours: a first point and operations, L with one point and Q with a control point and an end."""
        if glyph >= self.n_glyphs or depth > 8:
            return []
        at, size = self._place(glyph)
        if not size:
            return []
        (n,) = struct.unpack_from(">h", self.data, at)
        return self._simple(at + 10, n) if n >= 0 else self._composite(at + 10, depth)

    def _composite(self, at: int, depth: int) -> list[Contour]:
        out: list[Contour] = []
        more = True
        while more:
            flags, glyph = struct.unpack_from(">HH", self.data, at)
            at += 4
            kind = ">hh" if flags & 1 else ">bb"
            dx, dy = struct.unpack_from(kind, self.data, at)
            at += 4 if flags & 1 else 2
            f = lambda k, at=at: struct.unpack_from(f">{k}h", self.data, at)
            xx, xy, yx, yy = 1.0, 0.0, 0.0, 1.0
            if flags & 8:
                xx = yy = f(1)[0] / 16384
                at += 2
            elif flags & 0x40:
                xx, yy = (v / 16384 for v in f(2))
                at += 4
            elif flags & 0x80:
                xx, xy, yx, yy = (v / 16384 for v in f(4))
                at += 8
            move = complex(dx, dy) if flags & 2 else 0j
            for points, ops in self.outline(glyph, depth + 1):
                out.append(([complex(z.real * xx + z.imag * yx, z.real * xy + z.imag * yy) + move for z in points], ops))
            more = bool(flags & 0x20)
        return out

    def _simple(self, at: int, n: int) -> list[Contour]:
        if not n:
            return []
        ends = struct.unpack_from(f">{n}H", self.data, at)
        at += 2 * n
        at += 2 + struct.unpack_from(">H", self.data, at)[0]
        total = ends[-1] + 1
        flags: list[int] = []
        while len(flags) < total:
            f = self.data[at]
            at += 1
            times = 1
            if f & 8:
                times += self.data[at]
                at += 1
            flags += [f] * times
        axes = []
        for short, same in ((2, 16), (4, 32)):
            value, row = 0, []
            for f in flags[:total]:
                if f & short:
                    value += self.data[at] if f & same else -self.data[at]
                    at += 1
                elif not f & same:
                    value += struct.unpack_from(">h", self.data, at)[0]
                    at += 2
                row.append(value)
            axes.append(row)
        points = [complex(x, y) for x, y in zip(*axes, strict=True)]
        out, begin = [], 0
        for end in ends:
            ring = [(z, bool(f & 1)) for z, f in zip(points[begin : end + 1], flags[begin : end + 1], strict=True)]
            begin = end + 1
            if len(ring) > 1:
                out.append(_contour(ring))
        return out


def _contour(ring: list[tuple[complex, bool]]) -> Contour:
    """Points on and off the curve as lines and quadratics; two off points have one on the curve between them."""
    full: list[tuple[complex, bool]] = []
    for (z, on), (w, on2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        full.append((z, on))
        if not on and not on2:
            full.append(((z + w) / 2, True))
    start = next((i for i, (_, on) in enumerate(full) if on), 0)
    full = full[start:] + full[:start]
    points, ops, i = [full[0][0]], "", 1
    while i < len(full):
        if full[i][1]:
            points.append(full[i][0])
            ops += "L"
            i += 1
        else:
            points += [full[i][0], full[(i + 1) % len(full)][0]]
            ops += "Q"
            i += 2
    return points, ops


@lru_cache(maxsize=1)
def _installed() -> dict[tuple[str, bool, bool], str]:
    """Paths of the faces on this machine by family, bold and italic, from their file's own name table."""
    out: dict[tuple[str, bool, bool], str] = {}
    for folder in FOLDERS:
        for path in sorted(Path(folder).rglob("*.tt[fc]")) if os.path.isdir(folder) else ():
            try:
                family, style = _names(path.read_bytes())
            except (ValueError, struct.error, OSError):
                continue
            words = style.lower()
            if any(w in words for w in ("condensed", "light")):
                continue
            out.setdefault((family.lower(), "bold" in words, "italic" in words or "oblique" in words), str(path))
    return out


def _names(data: bytes) -> tuple[str, str]:
    """Family and style of a face."""
    (n,) = struct.unpack_from(">H", data, 4)
    for i in range(n):
        tag, _, at, _ = struct.unpack_from(">4sIII", data, 12 + 16 * i)
        if tag == b"name":
            _, count, texts = struct.unpack_from(">HHH", data, at)
            found = {}
            for k in range(count):
                platform, _, _, name, length, offset = struct.unpack_from(">HHHHHH", data, at + 6 + 12 * k)
                raw = data[at + texts + offset : at + texts + offset + length]
                if name in (1, 2):
                    found.setdefault(name, raw.decode("utf-16-be" if platform in (0, 3) else "latin-1", "replace"))
            return found.get(1, ""), found.get(2, "")
    raise ValueError("no names")


@lru_cache(maxsize=256)
def _asked(family: str, bold: bool, italic: bool) -> str | None:
    """The file that the machine's own font configuration picks."""
    style = ":bold" * bold + ":italic" * italic
    try:
        got = subprocess.run(["fc-match", "-f", "%{file}", f"{family.replace(':', ' ') or 'sans-serif'}{style}"], capture_output=True, text=True, timeout=20)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return got.stdout if got.returncode == 0 and got.stdout.lower().endswith((".ttf", ".ttc")) else None


@lru_cache(maxsize=64)
def face(family: str, bold: bool = False, italic: bool = False) -> Font | None:
    """The best face there is: what the font configuration picks, else the family itself, else a generic one; None on a
    machine without fonts."""
    here = _installed()
    name = GENERIC.get(family.lower(), family).lower()
    tries = [_asked(family, bold, italic)]
    for f in (name, GENERIC["sans-serif"].lower()):
        tries += [here.get((f, bold, italic)), here.get((f, bold, False)), here.get((f, False, False))]
    for path in [p for p in tries if p] + sorted(here.values())[:1]:
        try:
            return Font(Path(path).read_bytes())
        except (ValueError, struct.error, OSError):
            continue
    return None
