"""Whole jobs: render maps, run a suite, build a suite."""

from __future__ import annotations

import subprocess
import sys
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.report import Progress, paragraph
from tessera.operators import naming, sheets
from tessera.operators.compare import Options, Report, compare_files
from tessera.operators.render import FRAME, RESOLUTION, render
from tessera.sources import archive as A
from tessera.sources.xmap import parse_maps


class Failed(Exception):
    """What a person has to be told, and the exit code that goes with it."""

    def __init__(self, message: str, code: int = 1):
        super().__init__(message)
        self.code = code


def files_of(spark: SparkSession, items: list[tuple[str, bytes]], keys: tuple[str, ...] = ("map_id",)) -> DataFrame:
    return spark.createDataFrame(items, ", ".join([*(f"{k} string" for k in keys), "content binary"])).repartition(max(1, min(len(items), spark.sparkContext.defaultParallelism * 4)))


def map_to_image(spark: SparkSession, source: Path, target: Path, resolution: float = RESOLUTION, frame: float = FRAME) -> str:
    """Render one map to a file; the line that tells what was made."""
    if resolution <= 0 or frame < 0:
        raise Failed("the resolution must be above 0 and the frame 0 or more", 1)
    try:
        data = source.read_bytes()
    except OSError as e:
        raise Failed(f"Failed to load {source}: {e}", 2) from e
    t = parse_maps(files_of(spark, [(str(source), data)]))
    if error := t.maps.first().error:
        raise Failed(f"Failed to load {source}: {error}", 2)
    made = render(t, resolution, frame, target.suffix.lstrip(".").lower() or "png").collect()
    if not made:
        raise Failed("The requested image is empty.", 3)
    for w in t.warnings.orderBy("seq").collect():
        print(f"Warning: {w.message}", file=sys.stderr)
    r = made[0]
    try:
        target.write_bytes(r.content)
    except OSError as e:
        raise Failed(f"Failed to write {target}: {e}", 4) from e
    return f"{target}: {r.w}x{r.h} pixels, {r.ground_w}x{r.ground_h} m, 1:{r.scale_denominator}"


@dataclass
class Settings:
    resolution: float = RESOLUTION
    frame: float = FRAME
    archived: bool = False


def setting_lines(s: Settings, options: Options) -> list[tuple[str, str]]:
    source = "from the archive" if s.archived else "default; the archive carries no info.txt"
    return [
        ("resolution", f"{s.resolution:g} pixels per meter on the ground ({source})"), ("frame", f"{s.frame:g} meters on the ground ({source})"), ("tolerance", f"{options.tolerance}"),
        ("antialiasing", "counted as real" if options.keep_antialiasing else "classified and set aside"), ("crops", f"{options.crops or 'as many as it takes'}"), ("crop size", f"{options.crop_size} pixels"),
        ("zoom", f"{options.zoom} pixels"), ("overview", f"{options.overview or 'full size'}{' pixels' if options.overview else ''}"), ("filter", options.filter or "none"),
    ]


def run_suite(spark: SparkSession, source: Path, results: Path, options: Options, names_only: bool = False, say: Callable[[str], None] = print) -> tuple[Path, int]:
    """Check an archive's names, render its maps, compare them with its images and write the report. Gives the run's
    folder and the exit code, 2 if a map couldn't be rendered."""
    if not source.is_file():
        raise Failed(f"cannot open {source}")
    found = A.entries(files_of(spark, [(source.name, source.read_bytes())], ("archive",))).persist()
    guard = A.guarded(found).collect()
    if not guard or guard[0].error:
        raise Failed(f"{source} {guard[0].error if guard else 'holds no maps/*.omap'}")
    root = guard[0].root
    given = A.info(found).collect()
    settings = Settings(given[0].resolution, given[0].frame, True) if given else Settings()
    run = results / f"{source.stem}_{datetime.now():%Y-%m-%d_%H-%M-%S}"
    run.mkdir(parents=True, exist_ok=True)
    (run / "info.txt").write_text(f"Benchmark run of {source.name}\n\n" + "".join(f"{k:<14}{v}\n" for k, v in setting_lines(settings, options)) + "\n" + paragraph("Maps are rendered at the resolution, with the frame around them, and compared with the images of the archive pixel by pixel."))

    own = lambda folder: found.filter(F.col("folder") == folder).select("archive", "name")
    planned = naming.plan(own("maps"), own("expected")).persist()
    problems = [r.line for r in naming.problems(planned).orderBy("line").collect()]
    changed = {(r.folder, r.original): r.corrected for r in planned.filter("original <> corrected").collect()}
    if problems:
        summary = "".join(f"{r.n:6d}  {r.kind}\n" for r in naming.summary(planned).orderBy("place").collect())
        (run / "naming.txt").write_text(f"Problems by kind:\n\n{summary}\n" + "".join(f"{x}\n" for x in problems))
        if changed:
            A.write_corrected(source, source.with_name(f"{source.stem}_corrected.zip"), root, changed)
        say(f"{len(problems)} problem{'s' * (len(problems) != 1)} found and corrected; see {run / 'naming.txt'}")
    else:
        say("names are as they should be")
    if names_only:
        return run, 0

    extracted = A.extracted(found, planned).filter(F.contains("name", F.lit(options.filter))).persist()
    maps = parse_maps(extracted.filter("folder = 'maps'").select(F.col("name").alias("map_id"), "content"))
    stem = F.regexp_replace("map_id", r"(?i)\.(omap|xmap)$", ".png")
    drawn = render(maps, settings.resolution, settings.frame).select(stem.alias("name"), "content").persist()
    (run / "predictions").mkdir(exist_ok=True)
    for r in drawn.toLocalIterator():
        (run / "predictions" / r.name).write_bytes(r.content)
    failed = [r.map_id for r in maps.maps.filter("error is not null").select("map_id").orderBy("map_id").collect()]
    for name in failed:
        say(f"could not render {name}")

    (run / "differences").mkdir(exist_ok=True)
    compared = compare_files(extracted.filter("folder = 'expected'").select("name", "content"), drawn, options).persist()
    report = Report(compared.drop("files").collect())
    for r in compared.filter("status = 'differing'").select("name", "files").toLocalIterator():
        folder = run / "differences" / r.name.removesuffix(".png")
        folder.mkdir(exist_ok=True)
        for f in r.files:
            (folder / f.name).write_bytes(f.content)
    (run / "results.txt").write_text(report.text(source.stem, options))
    n = {s: sum(r.status == s for r in report.rows) for s in ("identical", "antialiasing", "differing", "missing")}
    total = len(report.rows)
    say(f"{total} image{'' if total == 1 else 's'}: {n['identical']} identical, {n['antialiasing']} antialiasing only, {n['differing']} differing" + (f", {n['missing']} not rendered" if n["missing"] else ""))
    return run, 2 if failed else 0


def draw_with(renderer: Path, source: Path, target: Path, resolution: float, frame: float) -> str | None:
    """Let an external renderer draw a map: what went wrong, or None."""
    try:
        got = subprocess.run([str(renderer), str(source), str(target), "-r", f"{resolution:g}", "-f", f"{frame:g}"], capture_output=True, text=True)
    except OSError as e:
        return str(e)
    if got.returncode or not target.is_file():
        return (got.stderr or got.stdout).strip().splitlines()[-1] if (got.stderr or got.stdout).strip() else f"exit status {got.returncode}"
    return None


def default_archive(source: Path, resolution: float) -> Path:
    stem = (source.resolve().name if source.is_dir() else source.stem).replace(" ", "_")
    return Path("benchmarks") / f"benchmark_{stem}_{resolution:g}_px_m.zip"


def build_suite(spark: SparkSession, renderer: Path, source: Path, output: Path | None = None, force: bool = False, resolution: float = RESOLUTION, frame: float = FRAME, name_filter: str = "", say: Callable[[str], None] = print) -> tuple[Path, int]:
    """Build an archive from a folder of maps, or from one map taken apart by symbol; reference images come from an
    external renderer. Gives the archive and the exit code, 2 if a map couldn't be drawn."""
    if resolution <= 0 or frame < 0:
        raise Failed("the resolution must be above 0 and the frame 0 or more")
    if not source.exists():
        raise Failed(f"no such file or folder: {source}")
    version = A.tool_version(renderer)
    if version is None:
        raise Failed(f"{renderer} does not answer to --version")
    target = output or default_archive(source, resolution)
    if target.exists() and not force:
        raise Failed(f"{target} exists already; use --force to replace it")
    with tempfile.TemporaryDirectory() as folder:
        work = Path(folder)
        if source.is_dir():
            entries = A.unique_names([*A.walk(source)], source)
        else:
            made = sheets.create_maps(files_of(spark, [(str(source), source.read_bytes())])).orderBy("symbol")
            for r in made.toLocalIterator():
                (work / f"{r.name}.omap").write_text(r.map)
                (work / f"{r.name}.txt").write_text(r.description)
            entries = A.unique_names([*A.walk(work)], work)
        entries = [e for e in entries if name_filter in f"{e[0]}{e[1]}"]
        if not entries:
            raise Failed(f"no maps in {source}")
        drawn, failures, progress = {}, [], Progress("Drawing", len(entries))
        (work / "images").mkdir()
        for name, suffix, path in entries:
            image = work / "images" / f"{len(drawn) + len(failures)}.png"
            if error := draw_with(renderer, path, image, resolution, frame):
                failures.append((f"{name}{suffix}", error))
            else:
                drawn[f"{name}{suffix}"] = (path, image)
            progress.tick()
        if not drawn:
            raise Failed("not one map could be drawn", 2)
        rows = [("suite", n) for n in drawn]
        images = [("suite", f"{n[:-5]}.png") for n in drawn]
        frame_of = lambda x: spark.createDataFrame(x, "archive string, name string")
        names = {(r.folder, r.original): r.corrected for r in naming.plan(frame_of(rows), frame_of(images)).collect()}
        root = target.stem
        order = sorted(drawn, key=lambda n: names["maps", n])
        files = [(f"{root}/maps/{names['maps', n]}", drawn[n][0].read_bytes()) for n in order]
        files += [(f"{root}/expected/{names['expected', f'{n[:-5]}.png']}", drawn[n][1].read_bytes()) for n in order]
        files += [(f"{root}/maps/{names['maps', n][:-5]}.txt", t.read_bytes()) for n in order if (t := drawn[n][0].with_suffix(".txt")).is_file()]
        files.append((f"{root}/info.txt", info_text(root, version, source, resolution, frame, len(order), failures).encode()))
        target.parent.mkdir(parents=True, exist_ok=True)
        A.write_zip(target, files)
    for name, error in failures:
        say(f"could not draw {name}: {error}")
    say(f"{target}: {len(order)} map{'s' * (len(order) != 1)}")
    return target, 2 if failures else 0


def info_text(title: str, version: str, source: Path, resolution: float, frame: float, count: int, failures: list[tuple[str, str]]) -> str:
    """An archive's info.txt: settings in the header, prose behind the first blank line."""
    out = f"resolution  {resolution:g} pixels per meter on the ground\nframe       {frame:g} meters on the ground\n\n"
    out += paragraph(f"{title}: {count} maps of {source.name} with reference images drawn by {version} on {datetime.now():%Y-%m-%d %H:%M}.")
    if failures:
        out += "Left out, as they could not be drawn:\n" + "".join(f"  {n}: {e}\n" for n, e in failures)
    return out
