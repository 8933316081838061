"""Command-line front end: the five modes end to end, from files to output files.

    python -m levelling.cli --mode 1 --points pts.csv --reference ref.csv --out out/
    python -m levelling.cli --mode 2 --points pts.csv --heights heights.parquet --out out/ \\
        --scope scope.csv --thin-spacing 25
    python -m levelling.cli --mode 4 --points xy.csv --heights heights.parquet --out out/
    python -m levelling.cli --mode 5 --scope scope.csv --spacing 25 --heights heights.parquet --out out/

Terrain heights come from a Parquet/table of ``n_cm, e_cm, h_ref`` (EPSG 2180
in whole centimetres); the network service is reached through the library's
``fetch`` argument, not from here.  Outputs follow the reference's names:
``tryb-{mode}_{base}.csv`` (with ``_split`` accurate/inaccurate partitions)
and a Parquet layer ``tryb-{mode}_{base}.parquet``.
"""

from __future__ import annotations

import argparse
import math
import posixpath

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.axes import check_zones
from .operators.grid import polygon_vertices
from .plans.pipelines import compare, enrich_heights, grid_heights, thin_accurate
from .session import ensure_checkpoint_dir, local_session, ship_package
from .sinks.writers import (BASE_NAMES, LAYER_NAMES, enrich_for_csv, output_name, spatial_layer,
                            write_csv, write_layer)
from .sources.delimited import read_points, read_scope


def number(text: str) -> float:
    """A finite number; decimal comma or point."""
    value = float(text.replace(",", "."))
    if not math.isfinite(value):
        raise argparse.ArgumentTypeError(f"{text!r} is not a finite number")
    return value


def _args(argv=None):
    p = argparse.ArgumentParser(prog="levelling")
    p.add_argument("--mode", type=int, required=True, choices=[1, 2, 3, 4, 5])
    p.add_argument("--points")
    p.add_argument("--reference")
    p.add_argument("--heights", help="Parquet table n_cm, e_cm, h_ref")
    p.add_argument("--scope", help="scope polygon file (thinning in modes 2/3, grid in mode 5)")
    p.add_argument("--out", required=True)
    p.add_argument("--max-distance", type=number, default=15.0)
    p.add_argument("--decimals", type=int, default=2)
    p.add_argument("--tolerance", type=number, default=0.2)
    p.add_argument("--height-tolerance", type=number, default=0.2)
    p.add_argument("--spacing", type=number, default=25.0, help="grid spacing (mode 5)")
    p.add_argument("--thin-spacing", type=number, default=None, help="thin accurate points (modes 2/3)")
    p.add_argument("--prefix", default="P")
    p.add_argument("--swap-points", action="store_true", help="x and y of --points are exchanged")
    p.add_argument("--swap-reference", action="store_true", help="x and y of --reference are exchanged")
    p.add_argument("--swap-scope", action="store_true", help="x and y of --scope are exchanged")
    p.add_argument("--swap-xy", action="store_true", help="all three of the above")
    p.add_argument("--on-bad", choices=["fail", "drop", "quarantine"], default="fail",
                   help="files with unreadable coordinates: stop, leave the file out, or leave the rows out")
    p.add_argument("--sep", default="auto")
    a = p.parse_args(argv)
    if a.swap_xy:
        a.swap_points = a.swap_reference = a.swap_scope = True
    return a


# Files are numbered each from 1: a row is identified by its file and its number.
FILE_KEY = ["source_file", "row_no"]
SCOPE_ORDER = ["source_file", "seq"]


def run(spark: SparkSession, argv=None) -> dict[str, str]:
    a = _args(argv)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    heights = spark.read.parquet(a.heights) if a.heights else None
    written: dict[str, str] = {}

    def out(base: str, ext: str) -> str:
        return posixpath.join(a.out, output_name(a.mode, base, ext))  # the writers make the folder

    if a.mode in (1, 2, 3):
        pts = read_points(spark, a.points, swap_xy=a.swap_points, sep=a.sep, prefix=a.prefix, on_bad=a.on_bad)
        ref = (read_points(spark, a.reference, swap_xy=a.swap_reference, sep=a.sep, on_bad=a.on_bad)
               if a.mode in (1, 3) else None)
        if a.mode in (2, 3) and heights is None:
            raise SystemExit("modes 2 and 3 need --heights")
        scope = None
        if a.scope:
            scope = read_scope(spark, a.scope, swap_xy=a.swap_scope, sep=a.sep)
            check_zones(pts, FILE_KEY, scope, SCOPE_ORDER)
        res = compare(pts, key=FILE_KEY, by="source_file", reference=ref, heights=heights if a.mode != 1 else None,
                      max_distance=a.max_distance, decimals=a.decimals, tolerance=a.tolerance,
                      height_tolerance=a.height_tolerance if a.mode != 1 else None)
        res = res.checkpoint()  # written several times below
        written["csv"] = out(BASE_NAMES["compare"], "csv")
        write_csv(res, written["csv"])
        written["layer"] = out(BASE_NAMES["compare"], "parquet")
        write_layer(spatial_layer(res, pts, FILE_KEY, LAYER_NAMES["compare"]), written["layer"])
        if a.mode in (2, 3) and scope is not None and a.thin_spacing is not None:
            thin = thin_accurate(res, polygon_vertices(scope), a.thin_spacing)
            written["thinned_csv"] = out(BASE_NAMES["thinned"], "csv")
            write_csv(thin, written["thinned_csv"], split_by_accuracy=False)
            written["thinned_layer"] = out(BASE_NAMES["thinned"], "parquet")
            write_layer(spatial_layer(thin, pts, FILE_KEY, LAYER_NAMES["thinned"]), written["thinned_layer"],
                        split_by_accuracy=False)
    elif a.mode == 4:
        if heights is None:
            raise SystemExit("mode 4 needs --heights")
        pts = read_points(spark, a.points, has_height=False, swap_xy=a.swap_points, sep=a.sep, prefix=a.prefix,
                          on_bad=a.on_bad)
        res = enrich_heights(pts, order=FILE_KEY, by="source_file", heights=heights, keep=["row_no"]).checkpoint()
        written["csv"] = out(BASE_NAMES["enrich"], "csv")
        write_csv(enrich_for_csv(res.drop("row_no")), written["csv"], split_by_accuracy=False)
        written["layer"] = out(BASE_NAMES["enrich"], "parquet")
        layer = spatial_layer(res.withColumnRenamed("h", "h_geoportal"), pts, FILE_KEY, LAYER_NAMES["enrich"])
        write_layer(layer, written["layer"], split_by_accuracy=False)
    else:
        if heights is None or not a.scope:
            raise SystemExit("mode 5 needs --scope and --heights")
        scope = read_scope(spark, a.scope, swap_xy=a.swap_scope, sep=a.sep)
        res = grid_heights(spark, polygon_vertices(scope), a.spacing, prefix=a.prefix, heights=heights)
        res = res.checkpoint()
        written["csv"] = out(BASE_NAMES["grid"], "csv")
        write_csv(enrich_for_csv(res.drop("seq_no")), written["csv"], split_by_accuracy=False)
        written["layer"] = out(BASE_NAMES["grid"], "parquet")
        centres = res.select("x", "y", F.col("seq_no"))
        layer = spatial_layer(res.withColumnRenamed("h", "h_geoportal"), centres, "seq_no", LAYER_NAMES["grid"])
        write_layer(layer, written["layer"], split_by_accuracy=False)
    return written


def main(argv=None) -> None:
    spark = local_session()
    for k, v in run(spark, argv).items():
        print(f"{k}: {v}")


if __name__ == "__main__":
    main()
