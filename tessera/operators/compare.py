"""Image comparison on whole pictures with numpy: the same rules as diff.py, for files, with the report's pictures."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions.font import face
from tessera.operators.diff import AGREE, ANTIALIASING, BLOCK, OVERVIEW_BYTES, REAL, TOLERANCE
from tessera.operators.raster import coverage
from tessera.sources import png
from tessera.sources.images import decode_as

#: Colours of the report's pictures (agreement, antialiasing, real difference), of what lies beside an
#: image, and the space between panels.
PALETTE = [(0, 0, 0), (70, 70, 120), (255, 60, 60)]
BESIDE, GAP = (32, 32, 32), 8


@dataclass
class Options:
    tolerance: int = TOLERANCE
    keep_antialiasing: bool = False
    crops: int = 0
    crop_size: int = 128
    zoom: int = 512
    overview: int = 2000
    filter: str = ""


@dataclass
class Comparison:
    mask: np.ndarray
    largest: int
    mean: float | None
    sd: float | None

    @property
    def n_real(self) -> int:
        return int((self.mask == REAL).sum())

    @property
    def n_antialiasing(self) -> int:
        return int((self.mask == ANTIALIASING).sum())


def edges(image: np.ndarray, tolerance: int) -> np.ndarray:
    """Whether the channels' ranges in each 3 x 3 neighbourhood add up to more than the tolerance."""
    low = high = image.astype(np.int16)
    for axis in (0, 1):
        pad = [(1, 1) if a == axis else (0, 0) for a in range(3)]
        for f, name in ((np.minimum, "low"), (np.maximum, "high")):
            x = np.pad(low if name == "low" else high, pad, mode="edge")
            n = x.shape[axis] - 2
            out = f(f(x.take(range(n), axis), x.take(range(1, n + 1), axis)), x.take(range(2, n + 2), axis))
            if name == "low":
                low = out
            else:
                high = out
    return (high - low).sum(2) > tolerance


def compare(expected: np.ndarray, predicted: np.ndarray, tolerance: int = TOLERANCE, keep_antialiasing: bool = False) -> Comparison:
    """Classes over the union of two images and the figures of the shared pixels; edges are only looked for where a
    pixel is wrong at all."""
    h, w = np.maximum(expected.shape[:2], predicted.shape[:2])
    sh, sw = np.minimum(expected.shape[:2], predicted.shape[:2])
    a, b = expected[:sh, :sw].astype(np.int16), predicted[:sh, :sw].astype(np.int16)
    distance = np.abs(a - b).sum(2)
    wrong = distance > tolerance
    mask = np.full((h, w), REAL, np.uint8)
    inside = np.where(wrong, REAL, AGREE).astype(np.uint8)
    if wrong.any() and not keep_antialiasing:
        inside[wrong & edges(a, tolerance) & edges(b, tolerance)] = ANTIALIASING
    mask[:sh, :sw] = inside
    values = distance[wrong].astype(np.int64)
    if not len(values):
        return Comparison(mask, int(distance.max(initial=0)), None, None)
    mean = values.sum() / len(values)
    return Comparison(mask, int(distance.max()), float(mean), float(np.sqrt(max(0.0, (values * values).sum() / len(values) - mean * mean))))


def worst_regions(mask: np.ndarray, count: int = 0, size: int = 128) -> list[tuple[int, int, int]]:
    """x, y and real differences of the worst regions, in turn."""
    h, w = mask.shape
    size = min(size, h, w)
    real = mask == REAL
    padded = np.pad(real, ((0, -h % BLOCK), (0, -w % BLOCK)))
    scores = padded.reshape(padded.shape[0] // BLOCK, BLOCK, -1, BLOCK).sum((1, 3)).astype(np.int64)
    out: list[tuple[int, int, int]] = []
    while not count or len(out) < count:
        by, bx = np.unravel_index(scores.argmax(), scores.shape) if scores.size else (0, 0)
        if not scores.size or scores[by, bx] <= 0:
            break
        x, y = (int(min(max(block * BLOCK + BLOCK // 2 - size // 2, 0), limit - size)) for block, limit in ((bx, w), (by, h)))
        out.append((x, y, int(real[y : y + size, x : x + size].sum())))
        scores[y // BLOCK : -(-(y + size) // BLOCK), x // BLOCK : -(-(x + size) // BLOCK)] = 0
    return out


def crop(image: np.ndarray, x: int, y: int, size: int, beside: tuple[int, int, int] = BESIDE) -> np.ndarray:
    out = np.full((max(1, size), max(1, size), 3), beside, np.uint8)
    part = image[y : y + size, x : x + size]
    out[: part.shape[0], : part.shape[1]] = part
    return out


def picture_of(mask: np.ndarray) -> np.ndarray:
    return np.array(PALETTE, np.uint8)[mask]


def magnify(image: np.ndarray, factor: int) -> np.ndarray:
    return image.repeat(factor, 0).repeat(factor, 1)


def lanczos(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """A smaller image by a windowed sinc of three lobes."""
    out = image.astype(np.float64)
    for axis, size in ((0, h), (1, w)):
        n = out.shape[axis]
        if n == size:
            continue
        scale = max(1.0, n / size)
        center = (np.arange(size) + 0.5) * n / size
        first = np.maximum(0, np.floor(center - 3 * scale)).astype(int)
        span = int(np.ceil(6 * scale)) + 2
        at = first[:, None] + np.arange(span)
        u = (at + 0.5 - center[:, None]) / scale
        weight = np.where(np.abs(u) < 3, np.sinc(u) * np.sinc(u / 3), 0.0) * (at < n)
        weight /= weight.sum(1, keepdims=True)
        moved = np.moveaxis(out, axis, 0)
        rows = np.stack([np.tensordot(weight[i], moved[np.minimum(at[i], n - 1)], 1) for i in range(size)])
        out = np.moveaxis(rows, 0, axis)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def draw_label(image: np.ndarray, text: str, x: int, y: int, size: int) -> None:
    """White text on an image, where the machine has a font."""
    font = face("sans-serif")
    if font is None:
        return
    scale, at = size / font.units, float(x)
    polygons = []
    for c in text:
        g = font.glyph(c)
        for points, ops in font.outline(g):
            ring = P.Outline([([complex(at + z.real * scale, y + (font.ascender - z.imag) * scale) for z in points], "", True)])
            ring.subpaths = [(p, o.replace("Q", "LL"), c2) for (p, _, c2), o in zip(ring.subpaths, [ops], strict=True)]
            polygons += [np.array(p) for p in ring.polygons()]
        at += font.advance(g) * scale
    cover = coverage(polygons, image.shape[1], image.shape[0], "winding")
    if cover is not None:
        image[:] = np.floor(image + (255.0 - image) * cover[:, :, None] + 0.5).astype(np.uint8)


def compose(panels: list[np.ndarray], labels: list[str]) -> np.ndarray:
    """Panels side by side under a bar of labels."""
    size = min(max(max(p.shape[1] for p in panels) // 40, 12), 40)
    bar = size + 8
    out = np.full((max(p.shape[0] for p in panels) + bar, sum(p.shape[1] for p in panels) + GAP * (len(panels) - 1), 3), BESIDE, np.uint8)
    x = 0
    for panel, label in zip(panels, labels, strict=True):
        out[bar : bar + panel.shape[0], x : x + panel.shape[1]] = panel
        top = out[:bar, x : x + panel.shape[1]]
        draw_label(top, label, 4, 4, size)
        x += panel.shape[1] + GAP
    return out


def too_big(shapes: list[tuple[int, int]]) -> bool:
    """Whether one of some (height, width) is over what an overview decodes."""
    return any(h * w * 3 > OVERVIEW_BYTES for h, w in shapes)


def artefacts(expected: np.ndarray, predicted: np.ndarray, found: Comparison, options: Options) -> Iterator[tuple[str, bytes]]:
    """File names and contents of what a pair with a real difference gets: diff.png, crops and side_by_side.png."""
    yield "diff.png", png.encode(found.mask, PALETTE)
    regions = worst_regions(found.mask, options.crops, options.crop_size)
    side = min(options.crop_size, *found.mask.shape)
    factor = max(1, options.zoom // max(1, side))
    colors = picture_of(found.mask)
    for n, (x, y, real) in enumerate(regions, 1):
        panels = [magnify(crop(i, x, y, side, b), factor) for i, b in ((expected, BESIDE), (predicted, BESIDE), (colors, (0, 0, 0)))]
        yield f"crop_{n:0{len(str(len(regions)))}d}_{x}x{y}.png", png.encode(compose(panels, ["expected", "predicted", f"difference, {real} px"]))
    if not too_big([expected.shape[:2], predicted.shape[:2]]):
        h, w = found.mask.shape
        width = min(w, options.overview) if options.overview else w
        height = max(1, round(h * width / w))
        whole = []
        for i in (expected, predicted, colors):
            full = np.full((h, w, 3), BESIDE, np.uint8)
            full[: i.shape[0], : i.shape[1]] = i
            whole.append(lanczos(full, width, height) if width < w else full)
        yield "side_by_side.png", png.encode(compose(whole, ["expected", "predicted", "difference"]))


COMPARED = "name string, status string, size long, n_aa long, n_real long, largest int, mean double, sd double, no_overview boolean, files array<struct<name:string,content:binary>>"


def compare_files(references: DataFrame, rendered: DataFrame, options: Options | None = None) -> DataFrame:
    """A row for each of references(name, content) whose name holds the filter, with what rendered(name, content) has of
    that name: status missing, identical, antialiasing, differing or unreadable, figures, and the pictures of a pair
    with a real difference."""
    options = options or Options()
    left = references.filter(F.contains("name", F.lit(options.filter))).select("name", F.col("content").alias("expected"))
    pairs = left.join(rendered.select("name", F.col("content").alias("predicted")), "name", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, a, p in zip(b.name, b.expected, b.predicted, strict=True):
                if p is None:
                    rows.append((name, "missing", None, None, None, None, None, None, False, []))
                    continue
                try:
                    one, two = decode_as(bytes(a), name), decode_as(bytes(p), name)
                except ValueError:
                    rows.append((name, "unreadable", None, None, None, None, None, None, False, []))
                    continue
                c = compare(one, two, options.tolerance, options.keep_antialiasing)
                status = "differing" if c.n_real else "antialiasing" if c.n_antialiasing else "identical"
                files = [{"name": n, "content": x} for n, x in artefacts(one, two, c, options)] if c.n_real else []
                rows.append((name, status, c.mask.size, c.n_antialiasing, c.n_real, c.largest, c.mean, c.sd, bool(c.n_real) and too_big([one.shape[:2], two.shape[:2]]), files))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in COMPARED.split(", ")]).astype({k: "Int64" for k in ("size", "n_aa", "n_real", "largest")})

    return pairs.mapInPandas(run, COMPARED)


@dataclass
class Report:
    rows: list = field(default_factory=list)

    def text(self, title: str, options: Options) -> str:
        """The results as a table, the worst first."""
        from tessera.functions.report import paragraph

        n = {s: sum(r.status == s for r in self.rows) for s in ("identical", "antialiasing", "differing", "missing")}
        total = len(self.rows)
        late = f", {n['missing']} not rendered" if n["missing"] else ""
        out = [f"Benchmark results: {title}\n\n", f"{total} image{'' if total == 1 else 's'} compared: {n['identical']} identical, {n['antialiasing']} antialiasing only, {n['differing']} differing{late}\n\n"]
        out.append(paragraph(f"A pixel's error is the sum of its differences in red, green and blue, 0 to 765; it is wrong beyond the tolerance of {options.tolerance}, or outside the other image. Wrong pixels are antialiasing where both images have an edge next to them, else real." + (" All are counted as real in this run." if options.keep_antialiasing else "")))
        out.append(paragraph("Rows are sorted by the share of real differences. Mean and standard deviation of the error are those of wrong pixels inside both images."))
        done = sorted((r for r in self.rows if r.size), key=lambda r: (-r.n_real / r.size, -(r.n_real + r.n_aa) / r.size, r.name))
        share = lambda x, r: f"{100 * x / r.size:.4f}%"
        table = [["real", "antialiasing", "wrong", "largest", "mean error of wrong px", "map"]]
        table += [[share(r.n_real, r), share(r.n_aa, r), share(r.n_real + r.n_aa, r), str(r.largest), "n/a" if r.mean is None else f"{r.mean:.2f} ± {r.sd:.2f}", r.name.removesuffix(".png")] for r in done]
        widths = [max(map(len, column)) for column in zip(*table, strict=True)]
        table.insert(1, ["-" * w for w in widths])
        out += ["  ".join([*(c.rjust(w) for c, w in zip(row[:-1], widths, strict=False)), row[-1]]).rstrip() + "\n" for row in table]
        for label, names in (("Not rendered, so not compared:", [r.name for r in self.rows if r.status == "missing"]), ("Too large for an overview:", [r.name for r in self.rows if r.no_overview])):
            if names:
                out.append("\n" + label + "\n" + "".join(f"  {x.removesuffix('.png')}\n" for x in sorted(names)))
        return "".join(out)
