"""Benchmark archives: zip files of maps/, expected/ and info.txt, and folders of maps."""

from __future__ import annotations

import io
import os
import subprocess
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

MAP_SUFFIXES = (".omap", ".xmap")
ENTRIES = "archive string, root string, folder string, name string, entry string, content binary"


def wanted(entry: str) -> tuple[str, str, str] | None:
    """Root, folder (maps or expected) and file name of an entry that belongs to a suite."""
    name = entry.replace("\\", "/")
    if name.endswith("/") or name.startswith(("__MACOSX/", ".")) or "/." in name:
        return None
    parent, slash, file = name.rpartition("/")
    if not slash:
        return None
    root, _, folder = parent.rpartition("/")
    root = f"{root}/" if root or parent.startswith("/") else ""
    lower = file.lower()
    if folder.lower() == "maps" and lower.endswith(MAP_SUFFIXES):
        return root, "maps", file
    return (root, "expected", file) if folder.lower() == "expected" and lower.endswith(".png") else None


def entries(archives: DataFrame) -> DataFrame:
    """A row for each map and reference image of archives(archive string, content binary), and for info.txt files
    (folder info)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("archive", pa.string()), ("root", pa.string()), ("folder", pa.string()), ("name", pa.string()), ("entry", pa.string()), ("content", pa.binary())])
        for b in batches:
            for archive, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    for info in z.infolist():
                        at = wanted(info.filename)
                        if at is None and info.filename.rpartition("/")[2] == "info.txt":
                            at = info.filename.removesuffix("info.txt"), "info", "info.txt"
                        if at:
                            row = dict(zip(schema.names, (archive, *at, info.filename, z.read(info)), strict=True))
                            yield pa.RecordBatch.from_pylist([row], schema)

    return archives.select("archive", "content").mapInArrow(run, ENTRIES)


def guarded(found: DataFrame) -> DataFrame:
    """archive, root, error: the one root of each archive's maps and images, or what is wrong with it."""
    kinds = found.filter("folder <> 'info'").groupBy("archive").agg(F.collect_set("root").alias("roots"), F.count_if(F.col("folder") == "maps").alias("maps"))
    named = F.array_join(F.transform(F.array_sort("roots"), lambda r: F.concat(F.lit('"'), r, F.lit('"'))), " and ")
    error = F.when(F.col("maps") == 0, "holds no maps/*.omap").when(F.size("roots") > 1, F.concat(F.lit("holds more than one maps/expected pair, under "), named))
    return kinds.select("archive", F.element_at(F.array_sort("roots"), 1).alias("root"), error.alias("error"))


def info(found: DataFrame) -> DataFrame:
    """archive, resolution, frame of the archives whose info.txt gives both."""
    resolution, frame = T.settings(F.decode("content", "utf-8"))
    rows = found.filter("folder = 'info'").join(guarded(found).select("archive", "root"), ["archive", "root"])
    return rows.select("archive", resolution.alias("resolution"), frame.alias("frame")).filter("resolution is not null")


def extracted(found: DataFrame, planned: DataFrame) -> DataFrame:
    """archive, folder, original, name (corrected), content of maps and images, by naming.plan()."""
    names = planned.select("archive", "folder", F.col("original").alias("name"), "corrected")
    joined = found.filter("folder <> 'info'").join(names, ["archive", "folder", "name"])
    return joined.select("archive", "folder", F.col("name").alias("original"), F.col("corrected").alias("name"), "content")


def write_zip(path: str | Path, files: Iterable[tuple[str, bytes]]) -> None:
    """An archive of named files, in their order."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files:
            z.writestr(name, content)


def write_corrected(source: str | Path, target: str | Path, root: str, renamed: dict[tuple[str, str], str]) -> None:
    """A copy of an archive whose maps and images have other names; everything else stays as it is."""
    with zipfile.ZipFile(source) as old, zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as new:
        for item in old.infolist():
            at = wanted(item.filename)
            name = f"{root}{at[1]}/{renamed.get(at[1:], at[2])}" if at else item.filename
            new.writestr(zipfile.ZipInfo(name, item.date_time), b"" if item.is_dir() else old.read(item), zipfile.ZIP_DEFLATED)


def walk(folder: str | Path) -> Iterator[Path]:
    """Map files of a folder by name, then those of its folders by name; hidden names and links to folders are left
    out."""
    here = sorted((e for e in os.scandir(folder) if not e.name.startswith(".")), key=lambda e: e.name)
    for e in here:
        if not e.is_dir(follow_symlinks=False) and len(e.name) > 5 and e.name.lower().endswith(MAP_SUFFIXES):
            yield Path(e.path)
    for e in here:
        if e.is_dir(follow_symlinks=False):
            yield from walk(e.path)


def unique_names(paths: list[Path], root: Path) -> list[tuple[str, str, Path]]:
    """Name, suffix and path of each map. A name that is taken grows by the folders it lies in, the nearest first, and
    then by a number."""
    taken: set[str] = set()
    out = []
    for path in paths:
        relative = path.relative_to(root) if path.is_relative_to(root) else path
        folders = [*relative.parent.parts]
        name, suffix = relative.name[:-5], relative.name[-5:]
        while name in taken and folders:
            name = f"{folders.pop()}_{name}"
        if name in taken:
            name = next(f"{name}_{n}" for n in range(2, len(taken) + 3) if f"{name}_{n}" not in taken)
        taken.add(name)
        out.append((name, suffix, path))
    return out


def tool_version(program: str | Path) -> str | None:
    """What a renderer answers to --version, on one line; None if it doesn't run."""
    try:
        got = subprocess.run([str(program), "--version"], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    lines = (got.stdout or got.stderr).strip().splitlines()
    return lines[0].strip() if got.returncode == 0 and lines else None
