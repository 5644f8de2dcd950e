import math
import zipfile

import numpy as np
import pytest

from tessera.functions import font, number, report
from tessera.functions import paths as P
from tessera.operators import compare, layout, raster, sheets
from tessera.operators.expand import Expander, pattern_lines, pattern_sites
from tessera.operators.writer import map_xml, object_xml
from tessera.plans import suite
from tessera.sources import archive, png
from tessera.sources.xmap import Reader, coordinates, fragments, parse_maps

EMPTY = b'<?xml version="1.0"?><map version="9"><georeferencing scale="15000"/><colors count="0"/><barrier version="6"><symbols count="0"/></barrier><parts><part name="p"><objects count="0"/></part></parts></map>'
#: A garden: a bed, gravel, a hedge, a sundial with a label, and a bed with a border.
INKS = [("Ink", "0", "0", "0", "0.8", None), ("Water", "0.5", "0.25", "0", "0.2", "0.1 0.2 0.3"), ("Clay", None, None, None, None, "0.8 0.4 0.2")]


def _color(i: int, name: str, *ink: str | None) -> str:
    cmyk = "".join(f' {k}="{v}"' for k, v in zip("cmyk", ink[:4], strict=True) if v is not None)
    rgb = "<rgb {}/>".format(" ".join(f'{k}="{v}"' for k, v in zip("rgb", ink[4].split(), strict=True))) if ink[4] else ""
    return f'<color priority="{i}" name="{name}"{cmyk}>{rgb}</color>' if rgb else f'<color priority="{i}" name="{name}"{cmyk}/>'


def _symbol(i: int, kind: int, code: str, name: str, inner: str) -> str:
    return f'<symbol type="{kind}" id="{i}" code="{code}" name="{name}">{inner}</symbol>'


def _object(kind: int, symbol: int, coords: str, more: str = "", inner: str = "") -> str:
    return f'<object type="{kind}" symbol="{symbol}"{more}><coords>{coords}</coords>{inner}</object>'


KINDS = [
    (4, "12.4", "Flower &lt;i&gt;bed", '<area_symbol inner_color="2" min_area="0"/>'),
    (4, "31", "Gravel", '<area_symbol inner_color="-1"><pattern type="1" angle="0" line_spacing="800" color="1" line_width="200"/></area_symbol>'),
    (2, "7.25", "Hedge", '<line_symbol color="0" line_width="300" join_style="2" dashed="true" dash_length="1700" break_length="400"/>'),
    (1, "55", "Sundial", '<point_symbol rotatable="false" inner_radius="450" inner_color="0" outer_width="0" outer_color="-1"/>'),
    (8, "90.1", "Label", '<text_symbol rotatable="false"><font family="sans-serif" size="3200"/><text color="0" kerning="true"/></text_symbol>'),
    (16, "08.2", "Bordered bed", '<combined_symbol><part symbol="0"/><part private="true"><symbol type="2"><line_symbol color="1" line_width="120"/></symbol></part><part symbol="64"/></combined_symbol>'),
]
PLACED = [
    _object(1, 0, "1000 1000;7000 1500;3500 6200;1000 1000 18;"),
    _object(1, 1, "9000 500;14500 500;14500 5300;9000 5300;9000 500 18;"),
    _object(1, 2, "500 8000;6500 9500;12000 7600;"),
    _object(0, 3, "7200 11300;"),
    _object(4, 4, "6200 13000;1100 700;", ' h_align="1" v_align="2"', "<text>Noon &amp; x</text>"),
    _object(1, 5, "18000 2000;23500 2600;19200 7000;18000 2000 18;"),
    _object(0, 83, "0 0;"),
    '<object type="9"/>',
]
GARDEN = "".join(
    ['<map version="10"><georeferencing scale="10000"/><colors>', *[_color(i, *ink) for i, ink in enumerate(INKS)], '</colors><barrier version="6"><symbols>', *[_symbol(i, *k) for i, k in enumerate(KINDS)], '<symbol type="3" id="6"/></symbols></barrier><parts><part><objects>', *PLACED, "</objects></part></parts></map>"]
).encode()


def test_reader_tables():
    r = Reader(GARDEN)
    assert (r.scale, len(r.colors), len(r.symbols), len(r.objects)) == (10_000, 3, 6, 7)
    assert [round(r.colors[1][c], 6) for c in "rgb"] == [0.4, 0.6, 0.8] and r.colors[2]["r"] == pytest.approx(0.8)
    assert len(r.warnings) == 3
    assert r.objects[4]["box"] == pytest.approx([1.1, 0.7]) and len(r.objects[4]["coords"]) == 1 and r.objects[4]["text"] == "Noon & x"
    parts = [row for kind, _, row in r.rows() if kind == "parts"]
    assert [(p["part_id"], p["own"]) for p in parts] == [(0, None), (None, 6), (64, None)]
    assert Reader(EMPTY).objects == [] and Reader(EMPTY).scale == 15_000
    with pytest.raises(ValueError):
        Reader(b"<other/>")
    with pytest.raises(ValueError):
        Reader(b"<map><a></b></map>")
    assert len(Reader(GARDEN[: GARDEN.index(b"</parts>")]).objects) == 7  # a file that ends early


def test_coordinates_stop_at_the_first_bad_record():
    assert coordinates("500 -250;7000 0 1;61 45;500 -250 18;") == [pytest.approx(c) for c in ([0.5, -0.25, 0], [7, 0, 1], [0.061, 0.045, 0], [0.5, -0.25, 18])]
    assert coordinates("1 2 x;3 4\n 1 ; 5 6.5;7 8") == [[0.001, 0.002, 0], [0.003, 0.004, 1]]


def test_fragments_are_verbatim():
    f = fragments(GARDEN)
    assert [n for n, _ in f["symbol"]] == [0, 1, 2, 3, 4, 5, 6] and f["symbol"][6][1] == b'<symbol type="3" id="6"/>'
    assert f["color"][0][1].startswith(b'<color priority="0" name="Ink"') and f["symbol"][0][1].endswith(b"</symbol>")


def test_numbers():
    for v, text in ((0.0, "0"), (0.1, "0.1"), (1234567.0, "1.23457e+06"), (123456.5, "123457"), (1e-5, "1e-05"), (0.0001, "0.0001"), (-2.5, "-2.5"), (math.pi / 4, "0.785398"), (1e5, "100000"), (999999.5, "1e+06"), (0.5, "0.5")):
        assert number.qt_number(v) == text
    assert number.qt_number(1250.0, 2) == "1.3e+03" and number.native(-1.2375) == -1237


def test_wrapping():
    assert report.wrap("aa bb cc", 5) == "aa bb\ncc" and report.wrap("a\n\n b", 9, "  ") == "  a\n\n  b"
    assert report.wrap("averylongword x", 4) == "averylongword\nx" and report.wrap("± ± ±", 3) == "± ±\n±"
    assert [report.clock(x) for x in (0, 61, 3661, -1, float("nan"))] == ["00:00", "01:01", "1:01:01", "??:??", "??:??"]


def square(n=4):
    return P.Coords([0j, n + 0j, n + n * 1j, n * 1j, 0j], [0, 0, 0, 0, P.CLOSE | P.HOLE])


def test_flattening_and_places():
    (p,) = P.flatten(square())
    assert p.length == 16 and p.closed
    assert P.point_at(square(), p, 6) == 4 + 2j and P.tangent_at(square(), p, 6).imag > 0
    curve = P.Coords([0j, 1j, 1 + 1j, 1 + 0j], [P.CURVE, 0, 0, 0])
    (p,) = P.flatten(curve)
    assert abs(p.length - 2.0) < 0.05
    z, way = P.locate(curve, p, p.length / 2)
    assert abs(z - (0.5 + 0.75j)) < 0.01 and abs(way.imag) < 0.05
    assert P.flatten(P.Coords([0j], [0])) == []
    two = P.Coords([0j, 1 + 0j, 5j, 6j], [0, P.HOLE, 0, 0])
    assert [len(x.points) for x in P.flatten(two)] == [2, 2]


def test_slices_of_curves_join_again():
    curve = P.Coords([0j, 4j, 6 + 4j, 6 + 0j, 9 + 0j], [P.CURVE, 0, 0, 0, 0])
    (p,) = P.flatten(curve)
    for cut in (0.5, 2.0, 5.0, p.length - 1):
        a, b = P.sliced(curve, p, 0, cut), P.sliced(curve, p, cut, p.length)
        total = sum(x.length for c in (a, b) for x in P.flatten(c))
        assert total == pytest.approx(p.length, abs=0.03) and a.z[-1] == b.z[0] and b.z[-1] == 9
    whole = P.sliced(curve, p, 0, p.length)
    assert whole.z == curve.z and whole.flags[0] & P.CURVE


def test_parallels_keep_their_distance():
    line = P.Coords([0j, 10 + 0j, 10 + 10j], [0, 0, 0])
    beside = P.parallel(line, 0, 2, False, 1.0, 0.0, "miter")
    assert beside.z[0] == 1j and beside.z[-1] == 9 + 10j and any(abs(z - (9 + 1j)) < 1e-9 for z in beside.z)
    outside = P.parallel(line, 0, 2, False, -1.0, 0.0, "miter")
    assert any(abs(z - (11 - 1j)) < 1e-6 for z in outside.z)
    curve = [0j, 5j, 10 + 5j, 10 + 0j]
    for d in (1.0, -1.0):
        points = [z for q in P.parallel_curve(curve, d) for z in (P.bezier(q, t / 10) for t in range(11))]
        near = [min(abs(z - P.bezier(curve, t / 500)) for t in range(501)) for z in points]
        assert max(abs(n - 1) for n in near) < 0.1
    assert P.parallel_curve([1j] * 4, 1.0) == []


def test_extents_by_cap_and_join():
    line = P.Coords([0j, 10 + 0j], [0, 0])
    parts = P.flatten(line)
    assert P.stroke_extent(line, parts, 1, "flat", "miter") == pytest.approx((0, -1, 10, 1), abs=1e-3)
    assert P.stroke_extent(line, parts, 1, "square", "miter") == pytest.approx((-1, -1, 11, 1))
    assert P.stroke_extent(line, parts, 1, "round", "miter") == pytest.approx((-1, -1, 11, 1))
    corner = P.Coords([0j, 10 + 0j, 10 + 10j], [0, 0, 0])
    assert P.stroke_extent(corner, P.flatten(corner), 1, "flat", "miter") == pytest.approx((0, -1, 11, 10), abs=1e-3)
    assert P.united((0, 0, 0, 0), None) is None and P.united((5, 5, 5, 5), (1, 1, 2, 2)) == (1, 1, 2, 2)


def test_folds():
    fold = lambda z: P.fold(c := P.Coords(z, [0] * len(z)), P.flatten(c), 1.0)
    assert fold([0j, 5 + 0j, 5 + 5j]) == P.NO_FOLD and fold([0j, 5 + 0j, 0j]) == P.REVERSAL and fold([0j, 5 + 0j, 0.01j]) == P.DANGEROUS


def test_containment_and_outlines():
    hole = P.Coords([*square(10).z, 3 + 3j, 6 + 3j, 6 + 6j, 3 + 6j, 3 + 3j], [0, 0, 0, 0, 18, 0, 0, 0, 0, 18])
    shape = P.outline(hole, False)
    assert shape.contains(1 + 1j) and not shape.contains(4 + 4j) and not shape.contains(11 + 1j)
    assert P.ellipse(0j, 2, 1).contains(1.9 + 0j) and not P.ellipse(0j, 2, 1).contains(1.9 + 0.9j)
    gaps = P.Coords([0j, 1 + 0j, 2 + 0j, 3 + 0j], [0, P.GAP, P.GAP, 0])
    assert [p for p, _, _ in P.outline(gaps, True).subpaths] == [[0j, 1 + 0j], [2 + 0j, 3 + 0j]]
    assert len(P.outline(gaps, False).subpaths) == 1


LINE = {"dash_length": 2.0, "break_length": 0.5, "in_group_break_length": 0.0, "dashes_in_group": 1, "half_outer_dashes": False, "mid_symbols_per_spot": 1, "mid_symbol_distance": 0.0, "mid_symbol_placement": 0, "show_at_least_one_symbol": False, "segment_length": 4.0, "end_length": 0.0}


def drawn(c):
    return [(p[0].real, p[-1].real) for p, _, _ in P.outline(c, True).subpaths]


def test_dashes():
    line = P.Coords([0j, 12 + 0j], [0, 0])
    (p,) = P.flatten(line)
    got = drawn(layout.Dashes(line, p, LINE).laid_out(0, 12))
    assert len(got) == 5 and got[0][0] == 0 and got[-1][1] == 12
    assert all(b - a == pytest.approx(2, abs=1e-5) for a, b in got) and all(c - b == pytest.approx(0.5, abs=1e-5) for (_, b), (c, _) in zip(got, got[1:], strict=False))
    assert drawn(layout.Dashes(line, p, LINE | {"half_outer_dashes": True}).laid_out(0, 12))[0][1] < 1.5
    assert drawn(layout.Dashes(line, p, LINE).laid_out(0, 2.4)) == [pytest.approx((0, 2.4), abs=1e-6)]
    pairs = drawn(layout.Dashes(line, p, LINE | {"dashes_in_group": 2, "in_group_break_length": 0.2, "dash_length": 1.0}).laid_out(0, 12))
    assert len(pairs) % 2 == 0 and pairs[1][0] - pairs[0][1] == pytest.approx(0.2, abs=1e-5)
    bent = P.Coords([0j, 6 + 0j, 12 + 0j], [0, P.DASH, 0])
    (p,) = P.flatten(bent)
    across = [(a, b) for a, b in drawn(layout.Dashes(bent, p, LINE).laid_out(0, 12)) if a < 6 < b]
    assert across and across[0][0] + across[0][1] == pytest.approx(12, abs=1e-4)


def test_mid_symbols():
    line = P.Coords([0j, 12 + 0j], [0, 0])
    (p,) = P.flatten(line)
    assert layout.mid_positions(p, LINE) == pytest.approx([0, 4, 8, 12])
    assert layout.mid_spots(12, LINE | {"end_length": 2.0}) == pytest.approx([2, 6, 10])
    assert layout.mid_spots(1, LINE | {"end_length": 2.0}) == []
    for where, want in ((0, 5), (1, 5), (2, 4), (99, 0)):
        at = []
        layout.Dashes(line, p, LINE | {"mid_symbol_placement": where}, at.append).laid_out(0, 12)
        assert len(at) == want, where


def test_patterns():
    assert [a.imag for a, _, _ in pattern_lines((0, 0, 4, 4), 0.0, 1.0, 0.5)] == [0.5, 1.5, 2.5, 3.5]
    slanted = [*pattern_lines((0, 0, 4, 4), math.pi / 4, 1.0, 0.0)]
    assert len(slanted) == 5 and all(-1e-9 <= v <= 4 + 1e-9 for a, b, _ in slanted for z in (a, b) for v in (z.real, z.imag))
    assert pattern_sites(0.3 + 0j, 5 + 0j, 2.0, 0.0) == pytest.approx([2, 4])
    assert pattern_sites(0j, 1e9 + 0j, 0.001, 0.0) == []


def test_expansion():
    r = Reader(GARDEN)
    e = Expander(frozenset([0, 1, 2, -900]))
    for o in r.objects[:4]:
        e.draw(r.symbols[o["symbol_id"]], o)
    assert [s.color for s in e.shapes] == [2] + [1] * 6 + [0, 0] and all(s.clip == 0 for s in e.shapes[1:7])
    assert e.extent == pytest.approx((0.45, 0.5, 14.5, 11.75), abs=0.1)


def test_coverage_is_the_area():
    box = np.array([1 + 1j, 3.5 + 1j, 3.5 + 2.5j, 1 + 2.5j])
    cover = raster.coverage([box], 5, 5)
    assert cover.sum() == pytest.approx(3.75) and cover[1, 3] == pytest.approx(0.5) and cover[2, 1] == pytest.approx(0.5)
    ring = raster.coverage([box, box], 5, 5)
    assert ring is None or ring.sum() == pytest.approx(0, abs=1e-9)
    assert raster.coverage([box, box], 5, 5, "winding").sum() == pytest.approx(3.75)
    line = raster.stroke_polygons(np.array([1 + 2j, 9 + 2j]), False, 0.5, "flat", "miter", True)
    assert raster.coverage(line, 10, 5, "winding").sum() == pytest.approx(8)
    disc = raster.coverage([raster._disc(5 + 5j, 4)], 10, 10, "winding")
    assert disc.sum() == pytest.approx(math.pi * 16, rel=0.02)


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_round_trip(channels):
    image = np.random.default_rng(1).integers(0, 256, (7, 5, channels), dtype=np.uint8)
    back = png.decode(png.encode(image if channels > 1 else image[:, :, 0]))
    assert (back == (image[:, :, :3] if channels > 1 else image.repeat(3, 2))).all()
    places = np.array([[0, 1], [2, 0]], np.uint8)
    assert png.decode(png.encode(places, compare.PALETTE)).tolist() == [[list(compare.PALETTE[i]) for i in row] for row in places]
    with pytest.raises(ValueError):
        png.decode(b"GIF89a")
    assert png.encode_as(image[:, :, :1].repeat(3, 2), "x.bmp")[:2] == b"BM" and png.encode_as(image[:, :, :1].repeat(3, 2), "x.tif")[:2] == b"II"


def test_png_filters():
    import struct
    import zlib

    image = np.random.default_rng(2).integers(0, 256, (5, 4, 3), dtype=np.uint8)
    rows, above = [], np.zeros(12, int)
    for kind in range(5):
        row = image[kind].reshape(-1).astype(int)
        left = np.concatenate([[0] * 3, row[:-3]])
        corner = np.concatenate([[0] * 3, above[:-3]])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        rows.append(bytes([kind]) + ((row - [0, left, above, (left + above) // 2, near][kind]) % 256).astype(np.uint8).tobytes())
        above = row
    data = png._SIGNATURE + png._chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + png._chunk(b"IDAT", zlib.compress(b"".join(rows))) + png._chunk(b"IEND", b"")
    assert (png.decode(data) == image).all()


def flat(h, w, v=255):
    return np.full((h, w, 3), v, np.uint8)


def test_comparison_rules():
    a, b = flat(3, 5, 100), flat(3, 5, 100)
    assert compare.compare(a, b).n_real == 0 and compare.compare(a, b).mean is None
    b[1, 2] = 101  # inside the tolerance
    c = compare.compare(a, b)
    assert (c.largest, c.mask.sum()) == (3, 0)
    b[1, 2] = 110
    c = compare.compare(a, b)
    assert (c.n_real, c.largest, c.mean, c.sd) == (1, 30, 30.0, 0.0)
    edge = flat(3, 5, 0)
    edge[:, 3:] = 255
    blend = edge.copy()
    blend[:, 2] = 90
    assert compare.compare(edge, blend).n_antialiasing == 3 and compare.compare(edge, blend, keep_antialiasing=True).n_real == 3
    c = compare.compare(flat(3, 5), flat(4, 6))
    assert c.mask.shape == (4, 6) and c.n_real == 9 and c.mean is None


def test_worst_regions_and_crops():
    mask = np.zeros((200, 200), np.uint8)
    mask[100:110, 100:110] = compare.REAL
    mask[5, 5] = compare.REAL
    got = compare.worst_regions(mask, 0, 32)
    assert got[0][2] >= 64 and sum(g[2] for g in got) >= 100 and len(compare.worst_regions(mask, 1, 32)) == 1
    assert compare.crop(flat(4, 4), 2, 2, 4)[3, 3].tolist() == [32, 32, 32]
    assert compare.magnify(flat(2, 2), 3).shape == (6, 6, 3) and compare.lanczos(flat(40, 60, 7), 20, 10).tolist() == flat(10, 20, 7).tolist()
    assert compare.too_big([(11292, 15972)]) and not compare.too_big([(1000, 1000)])
    names = [n for n, _ in compare.artefacts(flat(200, 200), flat(200, 200, 0), compare.compare(flat(200, 200), flat(200, 200, 0)), compare.Options(crops=2))]
    assert names[0] == "diff.png" and names[-1] == "side_by_side.png" and sum(n.startswith("crop_") for n in names) == 2


def test_fonts_and_text(spark):
    f = font.face("sans-serif")
    if f is None:
        pytest.skip("no fonts here")
    assert f.advance(f.glyph("W")) > f.advance(f.glyph("i")) > 0 and len(f.outline(f.glyph("o"))) == 2
    assert len(f.outline(f.glyph("é"))) >= 2
    from tessera.operators.text import draw_text, lay_out

    r = Reader(GARDEN)
    symbol, o = r.symbols[4], r.objects[4]
    made = lay_out(f, symbol, o | {"box": None})
    box = made.text.box()
    assert box[0] + box[2] == pytest.approx(0, abs=60)
    assert lay_out(f, symbol, o | {"text": "a\nb", "v_align": 0}).text.box()[3] > lay_out(f, symbol, o | {"text": "a", "v_align": 0}).text.box()[3]
    e = Expander(frozenset([0]), draw_text)
    e.draw(symbol | {"framing": True, "framing_color": 0, "framing_mode": 1, "framing_line_half_width": 0.1, "line_below": True, "line_below_color": 0, "line_below_width": 0.2}, o)
    assert [s.width > 0 for s in e.shapes] == [True, False, False]


def test_written_objects_read_back():
    r = Reader(GARDEN)
    colors, symbols = ([t.decode() for _, t in fragments(GARDEN)[k]] for k in ("color", "symbol"))
    again = Reader(map_xml(r.scale, colors, symbols, r.objects, True).encode())
    strip = lambda o: {k: v for k, v in o.items() if k != "box"}
    assert [*map(strip, again.objects)] == [*map(strip, r.objects)] and len(again.symbols) == len(r.symbols)
    assert object_xml(r.objects[3], False) == '<object type="0" symbol="3"><coords count="1">7200 11300;</coords></object>'


def test_sheets():
    r = Reader(GARDEN)
    name, xml, text = sheets.build(GARDEN, 2, "x.omap")
    assert name == "003_line_7.25_Hedge" and len(Reader(xml.encode()).objects) == 15 and "r5c3: zigzag" in text
    assert len(Reader(sheets.build(GARDEN, 3, "x")[1].encode()).objects) == 1 and len(Reader(sheets.build(GARDEN, 4, "x")[1].encode()).objects) == 8
    name, xml, _ = sheets.build(GARDEN, 5, "x")
    both = Reader(xml.encode())
    assert name == "006_combined_8.2_Bordered_bed" and [s["file_id"] for s in both.symbols] == [0, 1] and both.symbols[1]["part_ids"] == [0, None, 64]
    widths = [max(x for x, _, _ in o["coords"]) - min(x for x, _, _ in o["coords"]) for o in Reader(sheets.build(GARDEN, 2, "x")[1].encode()).objects[:3]]
    assert widths == pytest.approx([0.5, 5, 10])
    assert sheets.base_name(0, r.symbols[0]) == "001_area_12.4_Flower_bed"
    assert [sheets.number_text(c) for c in ("07.1", "x", "", "1.2.3.4", "101.", "-1.2", ".1")] == ["7.1", "0", "", "1.2.3", "101", "", "0"]


@pytest.fixture(scope="module")
def tables(spark):
    return parse_maps(suite.files_of(spark, [("a", GARDEN), ("b", EMPTY), ("c", b"<x/>")]))


def test_tables_and_rendering(spark, tables):
    from tessera.operators import render as R

    assert {r.map_id: r.error is None for r in tables.maps.collect()} == {"a": True, "b": True, "c": False}
    assert tables.coords.filter("map_id = 'a'").count() == sum(len(o["coords"]) for o in Reader(GARDEN).objects)
    assert sorted((r.object_seq, tuple(r.way)) for r in R.draws(tables).collect()) == [(0, ()), (1, ()), (2, ()), (3, ()), (4, ()), (5, (0,)), (5, (1,))]
    got = {r.map_id: r for r in R.render(tables, 3.0, 50.0).collect()}
    assert set(got) == {"a", "b"} and (got["b"].w, got["b"].h, got["b"].ground_w) == (300, 300, 100)
    picture = png.decode(got["a"].content)
    assert picture.shape[:2] == (got["a"].h, got["a"].w) and (png.decode(got["b"].content) == 255).all()
    flat_colors = {tuple(c) for c in picture.reshape(-1, 3)[::7]}
    assert {(255, 255, 255), (204, 102, 51), (102, 153, 204), (51, 51, 51)} <= flat_colors
    small = {r.map_id: (r.w, r.h) for r in R.render(tables, 2.0, 25.0).collect()}
    assert small["b"] == (100, 100)


def test_suite_runs_and_repairs(spark, tmp_path):
    image = png.encode(flat(300, 300))
    good = tmp_path / "good.zip"
    archive.write_zip(good, [("maps/000__empty.xmap", EMPTY), ("expected/000__empty.png", image)])
    said = []
    run, code = suite.run_suite(spark, good, tmp_path / "r", compare.Options(), say=said.append)
    assert code == 0 and said == ["names are as they should be", "1 image: 1 identical, 0 antialiasing only, 0 differing"]
    row = next(x for x in (run / "results.txt").read_text().splitlines() if "000__empty" in x)
    assert row.split() == ["0.0000%", "0.0000%", "0.0000%", "0", "n/a", "000__empty"]
    wrong = flat(300, 300)
    wrong[50:60, 50:90] = 0
    bad = tmp_path / "bad.zip"
    info = b"resolution 3\nframe 50\n\nprose"
    archive.write_zip(bad, [("s/maps/10_c.xmap", EMPTY), ("s/maps/1_a.xmap", EMPTY), ("s/maps/2_b map.xmap", b"<no/>"), ("s/expected/10_c.png", png.encode(wrong)), ("s/expected/1_a.png", image), ("s/info.txt", info)])
    run, code = suite.run_suite(spark, bad, tmp_path / "r", compare.Options(crops=1), say=said.append)
    assert code == 2 and "from the archive" in (run / "info.txt").read_text()
    names = (run / "naming.txt").read_text()
    assert "maps/1_a.xmap -> maps/000__a.xmap" in names and "contains spaces" in names
    with zipfile.ZipFile(tmp_path / "bad_corrected.zip") as z:
        assert sorted(z.namelist()) == ["s/expected/000__a.png", "s/expected/002__c.png", "s/info.txt", "s/maps/000__a.xmap", "s/maps/001__b_map.xmap", "s/maps/002__c.xmap"]
    assert sorted(p.name for p in (run / "differences" / "002__c").iterdir())[-2:] == ["diff.png", "side_by_side.png"]
    with pytest.raises(suite.Failed):
        suite.run_suite(spark, tmp_path / "none.zip", tmp_path, compare.Options())


def test_suite_is_built(spark, tmp_path):
    stub = tmp_path / "renderer"
    stub.write_text('#!/bin/sh\nif [ "$1" = --version ]; then echo "stub 1"; exit 0; fi\ncase "$1" in *bad*) echo no >&2; exit 1;; esac\necho "$1" > "$2"\n')
    stub.chmod(0o755)
    source = tmp_path / "suite"
    for name in ("02 second.omap", "01 first.omap", "deep/10 third.xmap", "deep/bad.omap", "deep/notes.txt", ".hidden.omap"):
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_text(name)
    made, code = suite.build_suite(spark, stub, source, tmp_path / "out.zip", say=lambda _: None)
    with zipfile.ZipFile(made) as z:
        assert code == 2 and z.namelist() == ["out/maps/000__first.omap", "out/maps/001__second.omap", "out/maps/002__third.xmap", "out/expected/000__first.png", "out/expected/001__second.png", "out/expected/002__third.png", "out/info.txt"]
    with pytest.raises(suite.Failed):
        suite.build_suite(spark, stub, source, tmp_path / "out.zip")
    one = tmp_path / "symbols.omap"
    one.write_bytes(GARDEN)
    made, code = suite.build_suite(spark, stub, one, tmp_path / "sym.zip", say=lambda _: None)
    with zipfile.ZipFile(made) as z:
        assert code == 0 and "sym/maps/002__line_7.25_Hedge.omap" in z.namelist() and "sym/maps/002__line_7.25_Hedge.txt" in z.namelist()
    assert [n for n, _, _ in archive.unique_names([source / "a/x.omap", source / "b/x.omap", source / "b/x.xmap"], source)] == ["x", "b_x", "b_x_2"]


def test_arrivals_are_rendered_once(spark, tmp_path):
    from tessera.streaming.arrivals import render_arrivals

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xmap").write_bytes(EMPTY)
    for _ in range(2):
        render_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_command_line(tmp_path):
    from tessera.__main__ import main

    (tmp_path / "e.xmap").write_bytes(EMPTY)
    assert main(["render", str(tmp_path / "e.xmap"), "-r", "2", "-f", "25"]) == 0
    assert png.decode((tmp_path / "e.png").read_bytes()).shape == (100, 100, 3)
    assert main(["render", str(tmp_path / "none.xmap")]) == 2 and main(["render", str(tmp_path / "e.xmap"), "-r", "0"]) == 1
    (tmp_path / "bad.xmap").write_text("<x/>")
    assert main(["render", str(tmp_path / "bad.xmap")]) == 2 and main(["render", str(tmp_path / "e.xmap"), "-f", "0"]) == 3


def test_written_pictures_are_read_by_others(spark):
    """The JVM's own readers see what was written."""
    r = np.random.default_rng(5)
    image = np.zeros((37, 53, 3), np.uint8)
    image[:, :, 0], image[:, :, 1] = np.arange(53) * 4, np.arange(37)[:, None] * 6
    image[10:20, 10:30] = (255, 255, 255)
    image[25:30, 5:50] = r.integers(0, 255, (5, 45, 3))
    jvm = spark._jvm
    for suffix in ("png", "bmp", "tif", "jpg"):
        back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(png.encode_as(image, f"x.{suffix}")))
        assert (back.getWidth(), back.getHeight()) == (53, 37), suffix
        seen = np.array(list(back.getRGB(0, 0, 53, 37, None, 0, 53)), np.int64).reshape(37, 53) & 0xFFFFFF
        pixels = np.stack([seen >> 16, seen >> 8 & 255, seen & 255], 2)
        assert np.abs(pixels - image).max() <= (0 if suffix != "jpg" else 30) and np.abs(pixels - image).mean() < 3, suffix
