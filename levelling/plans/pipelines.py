"""The reference's five modes as DataFrame pipelines.

All functions are lazy: they return DataFrames and never collect rows.  The
few driver-side reads are single-row decisions (first-row axis order, the
right-hand bounding box used to size the pairing cells) and the vertices of
a scope polygon.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projection import project_2000_to_1992
from ..functions.numeric import zone_of
from ..functions.rounding import rint_n, rounded_difference
from ..operators import accuracy as acc
from ..operators.axes import detect_roles, roles_per_file
from ..operators.grid import numbered_centres, thin_to_grid
from ..functions.geometry import inside_polygon
from ..operators.lookup import fetch_heights, join_heights, with_height_key
from ..operators.pairing import PairColumns, nearest_pair

Fetch = Callable[[list[tuple[float, float]]], str]


def _validate(max_distance: float, decimals: int, tolerance, height_tolerance) -> None:
    if not 0 <= max_distance < math.inf:
        raise ValueError("max_distance must be a number >= 0 (0 = no limit)")
    if not 0 <= decimals <= 6:
        raise ValueError("decimals must be between 0 and 6")
    for t in (tolerance, height_tolerance):
        if t is not None and not 0 <= t < math.inf:
            raise ValueError("tolerances must be numbers >= 0")


def project_points(df: DataFrame, order: str | Sequence[str], x: str, y: str, by: str | None = None) -> DataFrame:
    """Axis roles from the first row, zone per row, EPSG 2180 coordinates and lookup key.

    With ``by`` (a file column) the first row of each file decides for that file.
    """
    if by is None:
        roles = detect_roles(df, order, x, y)
        t = df.withColumns({"__n": F.col(roles.northing), "__e": F.col(roles.easting)})
    else:
        t = roles_per_file(df, by, order, x, y).withColumnsRenamed(
            {"geodetic_northing": "__n", "geodetic_easting": "__e"})
    t = t.withColumn("__zone", zone_of("__e"))
    t = project_2000_to_1992(t, "__n", "__e", "__zone")
    return with_height_key(t).drop("__n", "__e", "__zone")


def service_heights(df: DataFrame, heights: DataFrame | None, fetch: Fetch | None,
                    out: str, zero_is_missing: bool, service: dict | None = None) -> DataFrame:
    """Heights from a table or from ``fetch``; ``service``: options of ``fetch_answers``."""
    if heights is None:
        if fetch is None:
            raise ValueError("give a height table or a fetch function")
        heights = fetch_heights(df.where(F.col("e_1992").isNotNull()), fetch, **(service or {}))
    return join_heights(df, heights, out=out, zero_is_missing=zero_is_missing)


def compare(points: DataFrame, *, key: str | Sequence[str], order: str | Sequence[str] | None = None,
            reference: DataFrame | None = None, heights: DataFrame | None = None,
            fetch: Fetch | None = None, max_distance: float = 15.0, decimals: int = 2,
            tolerance: float | None = 0.2, height_tolerance: float | None = 0.2,
            sort: bool = True, zero_is_missing: bool = False, pair_service_diff: bool = False,
            keep: Sequence[str] = (), by: str | None = None, service_options: dict | None = None) -> DataFrame:
    """Modes 1-3: points (id, x, y, h) against a reference file and/or terrain heights.

    ``key`` (one or more columns; ``["source_file", "row_no"]`` for files)
    is carried along for ``order`` and need not be unique; ``order`` (default ``key``)
    defines the first row for axis detection, which ``by`` (for instance
    ``source_file``) makes per file.  ``service_options``: ``tasks``,
    ``threads_per_task`` and the other options of ``fetch_answers``.  Returns
    the result columns of the mode in reference order, sorted by absolute
    difference unless ``sort=False``.  In mode 3 pairs are found first; the
    height lookup then runs on the paired rows.
    """
    _validate(max_distance, decimals, tolerance, height_tolerance)
    order = order or key
    service = heights is not None or fetch is not None
    file_pair = reference is not None
    if not service and not file_pair:
        raise ValueError("give a reference table, a height table or a fetch function")
    key = [key] if isinstance(key, str) else list(key)
    extra = list(dict.fromkeys([*key, *([order] if isinstance(order, str) else order), *keep,
                                *([by] if by else [])]))
    df = points.select(F.col("id").cast("string").alias("id_odniesienia"),
                       F.col("x").alias("x_odniesienia"), F.col("y").alias("y_odniesienia"),
                       F.col("h").alias("h_odniesienia"), *extra)
    if file_pair:
        ref = reference.select(F.col("id").cast("string").alias("id"), "x", "y", "h")
        df = nearest_pair(df, ref, max_distance, x="x_odniesienia", y="y_odniesienia",
                          right_payload=["h"], payload_out=["h_porownania"],
                          names=PairColumns())
    if service:
        df = project_points(df, order, "x_odniesienia", "y_odniesienia", by)
        df = service_heights(df, heights, fetch, "geoportal_h", zero_is_missing, service_options)
    df = acc.add_differences(df, decimals, file_pair=file_pair, service=service)
    df = acc.add_flag(df, tolerance=tolerance, height_tolerance=height_tolerance,
                      file_pair=file_pair, service=service)
    if pair_service_diff and service and file_pair:
        df = df.withColumn("diff_h_geoportal_pair",
                           rint_n(rounded_difference("h_porownania", "geoportal_h", decimals), decimals))
    df = acc.round_result(df, decimals)
    if sort:
        df = acc.sort_by_abs(df, "diff_h_geoportal" if service else "diff_h")
    extra_out = [c for c in keep if c not in acc.RESULT_COLUMNS]
    if pair_service_diff and service and file_pair:
        extra_out.append("diff_h_geoportal_pair")
    return acc.select_result(df, extra_out)


def enrich_heights(points: DataFrame, *, order: str | Sequence[str], heights: DataFrame | None = None,
                   fetch: Fetch | None = None, keep: Sequence[str] = (), by: str | None = None,
                   service_options: dict | None = None) -> DataFrame:
    """Mode 4: points (id, x, y) get a terrain height ``h``; x, y to 2 and h to 1 decimal."""
    df = points.select(F.col("id").cast("string").alias("id"), "x", "y",
                       *list(dict.fromkeys([*([order] if isinstance(order, str) else order), *keep,
                                            *([by] if by else [])])))
    df = project_points(df, order, "x", "y", by)
    df = service_heights(df, heights, fetch, "h", zero_is_missing=False, service=service_options)
    return df.select("id", rint_n("x", 2).alias("x"), rint_n("y", 2).alias("y"),
                     rint_n("h", 1).alias("h"), *[c for c in keep if c not in ("id", "x", "y", "h")])


def grid_heights(spark: SparkSession, vertices: Sequence[tuple[float, float]], spacing: float,
                 *, prefix: str = "P", heights: DataFrame | None = None,
                 fetch: Fetch | None = None) -> DataFrame:
    """Mode 5: hexagonal grid inside the polygon, numbered in (y, x) order, with heights."""
    centres = numbered_centres(spark, vertices, spacing, prefix)
    return enrich_heights(centres, order="seq_no", heights=heights, fetch=fetch, keep=["seq_no"])


def thin_accurate(result: DataFrame, vertices: Sequence[tuple[float, float]], spacing: float = 25.0,
                  *, key: str = "id_odniesienia") -> DataFrame:
    """Thinned grid of the accurate points of a mode 2/3 result (rows unchanged)."""
    if not spacing > 0:
        spacing = 25.0  # the reference silently keeps its default on a bad value
    need = ["x_odniesienia", "y_odniesienia", "h_odniesienia", "geoportal_h"]
    cand = (result.where(F.col("osiaga_dokladnosc") == acc.YES)
            .where(inside_polygon("x_odniesienia", "y_odniesienia", vertices))
            .dropna(subset=need))
    score = F.abs(F.col("h_odniesienia") - F.col("geoportal_h"))
    out = thin_to_grid(cand, vertices, spacing, key=key, score=score,
                       x="x_odniesienia", y="y_odniesienia")
    return out.drop("r", "c", "centre_distance")
