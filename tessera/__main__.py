"""python -m tessera render | bench | create ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera", description="Vector maps to pictures, and picture regression, on Spark.")
    kinds = out.add_subparsers(dest="job", required=True)
    render = kinds.add_parser("render", help="draw one map")
    render.add_argument("map", type=Path)
    render.add_argument("image", type=Path, nargs="?", help="its suffix picks PNG, BMP, TIFF or JPEG; else the map's name with .png")
    create = kinds.add_parser("create", help="build an archive with an external renderer")
    create.add_argument("renderer", type=Path)
    create.add_argument("source", type=Path)
    create.add_argument("-o", "--output", type=Path)
    create.add_argument("--force", action="store_true")
    for p in (render, create):
        p.add_argument("-r", "--resolution", type=float, default=3.0, help="pixels a metre on the ground")
        p.add_argument("-f", "--frame", type=float, default=50.0, help="metres of white around")
    bench = kinds.add_parser("bench", help="run an archive")
    bench.add_argument("archive", type=Path)
    bench.add_argument("--results", type=Path, default=Path("Results"))
    bench.add_argument("--names-only", action="store_true")
    bench.add_argument("--keep-antialiasing", action="store_true")
    for name, value in (("tolerance", 3), ("crops", 0), ("crop-size", 128), ("zoom", 512), ("overview", 2000)):
        bench.add_argument(f"--{name}", type=int, default=value)
    for p in (bench, create):
        p.add_argument("--filter", default="", help="only maps whose name contains this")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from tessera.operators.compare import Options
    from tessera.plans import suite

    spark = SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        if args.job == "render":
            print(suite.map_to_image(spark, args.map, args.image or args.map.with_suffix(".png"), args.resolution, args.frame))
            return 0
        if args.job == "bench":
            options = Options(args.tolerance, args.keep_antialiasing, args.crops, args.crop_size, args.zoom, args.overview, args.filter)
            return suite.run_suite(spark, args.archive, args.results, options, args.names_only)[1]
        return suite.build_suite(spark, args.renderer, args.source, args.output, args.force, args.resolution, args.frame, args.filter)[1]
    except suite.Failed as e:
        print(e, file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(main())
