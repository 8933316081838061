"""Planar geometry expressions: distance, point in polygon, point struct."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A literal polygon with more edges than this is tested through the
# ``aggregate`` higher-order function over the edges of the point's band
# instead of an unrolled expression.
UNROLL_EDGES = 64


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distance(x0, y0, x1, y1) -> Column:
    dx = _col(x0) - _col(x1)
    dy = _col(y0) - _col(y1)
    return F.sqrt(dx * dx + dy * dy)


def polygon_edges(vertices: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """Ring edges, the closing edge included, of a vertex list in ring order."""
    pts = [(float(x), float(y)) for x, y in vertices]
    if len(pts) < 3:
        raise ValueError("a scope polygon needs at least three vertices")
    return [(pts[i][0], pts[i][1], pts[(i + 1) % len(pts)][0], pts[(i + 1) % len(pts)][1])
            for i in range(len(pts))]


def _crossing(px: Column, py: Column, x0, y0, x1, y1) -> Column:
    # Crossings test: the edge straddles the horizontal line through the
    # point and crosses it to the right of the point.
    f0 = y0 >= py
    f1 = y1 >= py
    side = ((y1 - py) * (x0 - x1)) >= ((x1 - px) * (y0 - y1))
    return (f0 != f1) & (side == f1)


def inside_polygon(x: Column | str, y: Column | str,
                   vertices: Sequence[tuple[float, float]]) -> Column:
    """Even-odd point-in-polygon test against a literal polygon; a NULL coordinate is outside.

    Small rings become an unrolled expression, larger ones a banded edge
    table; both apply the same test to the same edges.
    """
    px, py = _col(x), _col(y)
    edges = polygon_edges(vertices)
    if len(edges) > UNROLL_EDGES:
        return inside_polygon_banded(px, py, edges)
    acc = F.lit(False)
    for x0, y0, x1, y1 in edges:
        acc = acc != _crossing(px, py, F.lit(x0), F.lit(y0), F.lit(x1), F.lit(y1))
    return F.coalesce(acc, F.lit(False))


_EDGE = "struct<x0:double,y0:double,x1:double,y1:double>"


def edge_bands(edges: Sequence[tuple[float, float, float, float]], edges_per_band: int = 4):
    """(lowest y, band height, edges per band): every edge stands in all bands its y-range touches.

    The number of bands follows the ring; it is halved while tall edges would
    stand in so many bands that the table exceeds eight times the ring.
    """
    ys = [v for e in edges for v in (e[1], e[3])]
    lo, hi = min(ys), max(ys)
    n = max(1, len(edges) // edges_per_band)
    while True:
        height = (hi - lo) / n if hi > lo else 1.0
        # one band of margin on each side: a rounding difference at a band
        # boundary between Python and Spark must not drop an edge
        spans = [(max(0, int((min(e[1], e[3]) - lo) // height) - 1),
                  min(n - 1, int((max(e[1], e[3]) - lo) // height) + 1)) for e in edges]
        if n == 1 or sum(b - a + 1 for a, b in spans) <= 8 * len(edges):
            break
        n = max(1, n // 2)
    bands: list[list[tuple]] = [[] for _ in range(n)]
    for e, (a, b) in zip(edges, spans):
        for k in range(a, b + 1):
            bands[k].append(e)
    return lo, hi, height, bands


def inside_polygon_banded(px: Column, py: Column, edges: Sequence[tuple[float, float, float, float]],
                          edges_per_band: int = 4) -> Column:
    """Even-odd test for large polygons: edges are bucketed into horizontal bands.

    Only edges whose y-range contains the point's y can cross its ray, and
    all of them overlap the point's band, so a point tests the few edges of
    its band instead of the whole ring.  Points outside the y-range are
    outside.  The table enters the plan as one JSON literal that the
    optimizer folds into an array, so the plan does not grow with the ring.
    """
    lo, hi, height, bands = edge_bands(edges, edges_per_band)
    text = json.dumps([[dict(zip(("x0", "y0", "x1", "y1"), e)) for e in band] for band in bands])
    table = F.from_json(F.lit(text), f"array<array<{_EDGE}>>")
    idx = F.least(F.floor((py - F.lit(lo)) / F.lit(height)), F.lit(len(bands) - 1)) + 1
    band_edges = F.when((py >= F.lit(lo)) & (py <= F.lit(hi)), F.try_element_at(table, idx.cast("int")))
    return F.coalesce(inside_polygon_edges(px, py, band_edges), F.lit(False))


def inside_polygon_edges(x: Column | str, y: Column | str, edges: Column) -> Column:
    """Even-odd test against an ``ARRAY<STRUCT<x0,y0,x1,y1>>`` column.

    Used when polygons come from a table (one row per polygon joined to the
    points) or for literal polygons with many vertices.
    """
    px, py = _col(x), _col(y)
    return F.aggregate(edges, F.lit(False),
                       lambda acc, e: acc != _crossing(px, py, e["x0"], e["y0"], e["x1"], e["y1"]))


def point_struct(x: Column | str, y: Column | str) -> Column:
    return F.struct(_col(x).alias("x"), _col(y).alias("y"))


def point_wkt(x: Column | str, y: Column | str) -> Column:
    return F.concat(F.lit("POINT ("), _col(x).cast("string"), F.lit(" "),
                    _col(y).cast("string"), F.lit(")"))
