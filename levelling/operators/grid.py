"""Hexagonal grids inside a polygon and thinning to such a grid.

Grid geometry (spacing ``d``, ``dy = d*sqrt(3)/2``): even rows start at
``min_y`` and step ``2*dy``, x from ``min_x`` in steps of ``d``; odd rows
start at ``min_y + dy``, x from ``min_x - d/2``.  Upper bounds are half-open at
``max + step``.  Row/column counts and the effective steps follow the
floating-point rule of numpy's ``arange`` (``n = ceil((stop-start)/step)``,
value ``i`` = ``start + i*((start+step)-start)``), so the centres are the
same doubles.  Centres are generated by ``spark.range`` index arithmetic; only
the four bounding-box numbers reach the driver.

Thinning: discs of radius ``d/2`` around centres at least ``d`` apart share
at most a tangent point, so "each centre in (y, x) order takes its best
untaken candidate" is an independent arg-min per centre.  A candidate finds
its (at most a few) centres by arithmetic -- no join and no pair
enumeration.  Exact tangencies, where one candidate wins two centres, are
settled afterwards in centre order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import distance, inside_polygon
from .numbering import index_in_place


@dataclass(frozen=True)
class Lattice:
    """One parity of rows: start values, effective steps and counts."""
    y0: float
    y_step: float
    n_rows: int
    x0: float
    x_step: float
    n_cols: int


def _arange(start: float, stop: float, step: float) -> tuple[float, float, int]:
    n = int(math.ceil((stop - start) / step))
    return start, (start + step) - start, max(n, 0)


@dataclass(frozen=True)
class HexGrid:
    min_x: float
    min_y: float
    max_x: float
    max_y: float
    spacing: float

    @property
    def dy(self) -> float:
        return self.spacing * math.sqrt(3) / 2

    def lattice(self, odd: bool) -> Lattice:
        d, dy = self.spacing, self.dy
        if odd:
            y0, ys, ny = _arange(self.min_y + dy, self.max_y + dy, dy * 2)
            x0, xs, nx = _arange(self.min_x - d / 2, self.max_x + d, d)
        else:
            y0, ys, ny = _arange(self.min_y, self.max_y + dy, dy * 2)
            x0, xs, nx = _arange(self.min_x, self.max_x + d, d)
        return Lattice(y0, ys, ny, x0, xs, nx)

    @property
    def candidate_count(self) -> int:
        e, o = self.lattice(False), self.lattice(True)
        return e.n_rows * e.n_cols + o.n_rows * o.n_cols


def bounding_box(vertices: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return vertices.agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"),
                        F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def polygon_vertices(vertices: DataFrame, order: str = "seq", x: str = "x", y: str = "y") -> list[tuple[float, float]]:
    """Vertex list of a scope polygon table, in ring order.

    A scope polygon is a parameter of the run: its ring is read to the driver
    to become a literal of the plan.
    """
    rows = vertices.select(order, x, y).orderBy(order).collect()
    pts = [(float(r[x]), float(r[y])) for r in rows]
    if len(pts) < 3:
        raise ValueError("a scope polygon needs at least three vertices")
    return pts


def grid_for(vertices: Sequence[tuple[float, float]], spacing: float) -> HexGrid:
    if not spacing > 0:
        raise ValueError("grid spacing must be > 0")
    xs = [p[0] for p in vertices]
    ys = [p[1] for p in vertices]
    return HexGrid(min(xs), min(ys), max(xs), max(ys), float(spacing))


def _lattice_points(spark: SparkSession, g: HexGrid, partitions: int) -> DataFrame:
    """All centres of the grid, partitions and rows in (r, c) order."""
    even, odd = g.lattice(False), g.lattice(True)
    first, second = (lat.n_cols if lat.n_rows else 0 for lat in (even, odd))
    both = first + second        # centres of an even row and the odd row after it
    if both == 0:
        return spark.createDataFrame([], "r long, c long, x double, y double")
    i = F.col("id")
    m = F.floor(i / F.lit(both))
    is_odd = i - m * F.lit(both) >= first

    def of(field: str) -> Column:
        return F.when(F.col("odd"), F.lit(getattr(odd, field))).otherwise(F.lit(getattr(even, field)))
    return (spark.range(0, max(even.n_rows, odd.n_rows) * both, numPartitions=partitions)
            .select(m.alias("m"), is_odd.alias("odd"), (i - m * F.lit(both) - F.when(is_odd, first).otherwise(0)).alias("c"))
            .where(F.col("m") < of("n_rows"))
            .select((F.col("m") * 2 + F.col("odd").cast("int")).alias("r"), "c",
                    (of("x0") + F.col("c").cast("double") * of("x_step")).alias("x"),
                    (of("y0") + F.col("m").cast("double") * of("y_step")).alias("y")))


def hex_centres(spark: SparkSession, vertices: Sequence[tuple[float, float]], spacing: float,
                *, inside_only: bool = True, rows_per_partition: int = 1_000_000) -> DataFrame:
    """Centres (r, c, x, y) of the hexagonal grid; by default only those inside the polygon."""
    g = grid_for(vertices, spacing)
    parts = max(spark.sparkContext.defaultParallelism, g.candidate_count // rows_per_partition + 1)
    pts = _lattice_points(spark, g, parts)
    if inside_only:
        # a generated row: a filter on plain columns would work out x and y again for every edge
        pts = (pts.select("r", "c", F.explode(F.array(F.struct("x", "y"))).alias("p")).select("r", "c", "p.x", "p.y")
               .where(inside_polygon("x", "y", vertices)))
    return pts


def numbered_centres(spark: SparkSession, vertices: Sequence[tuple[float, float]], spacing: float,
                     prefix: str = "P") -> DataFrame:
    """Centres inside the polygon numbered ``{prefix}_{i}`` in (y, x) order: id, x, y, r, c."""
    c = index_in_place(hex_centres(spark, vertices, spacing), out="seq_no")  # they come in (r, c) order
    return c.select(F.concat(F.lit(f"{prefix}_"), F.col("seq_no").cast("string")).alias("id"),
                    "x", "y", "r", "c", "seq_no")


def _centre_options(g: HexGrid, x: Column, y: Column) -> Column:
    """Array of the up-to-eight centres (two rows per parity, two columns per row)."""
    opts = []
    for parity in (0, 1):
        lat = g.lattice(parity == 1)
        if lat.n_rows == 0 or lat.n_cols == 0:
            continue
        m0 = F.floor((y - F.lit(lat.y0)) / F.lit(lat.y_step))
        c0 = F.floor((x - F.lit(lat.x0)) / F.lit(lat.x_step))
        for dm in (0, 1):
            for dc in (0, 1):
                m = m0 + dm
                c = c0 + dc
                ok = (m >= 0) & (m < lat.n_rows) & (c >= 0) & (c < lat.n_cols)
                opts.append(F.when(ok, F.struct(
                    (m * 2 + parity).alias("r"), c.alias("c"),
                    (F.lit(lat.x0) + c.cast("double") * F.lit(lat.x_step)).alias("cx"),
                    (F.lit(lat.y0) + m.cast("double") * F.lit(lat.y_step)).alias("cy"))))
    return F.filter(F.array(*opts), lambda s: s.isNotNull())


def centre_of(df: DataFrame, vertices: Sequence[tuple[float, float]], spacing: float,
              x: str = "x", y: str = "y") -> DataFrame:
    """Radius join against the grid: every (row, centre) with distance <= spacing/2.

    Adds r, c, cx, cy, centre_distance.  A row matches at most one centre
    except on exact tangency; centres outside the polygon are not matched.
    """
    g = grid_for(vertices, spacing)
    radius = g.spacing / 2.0
    e = df.withColumn("__o", F.explode(_centre_options(g, F.col(x), F.col(y))))
    e = e.select("*", F.col("__o.r").alias("r"), F.col("__o.c").alias("c"),
                 F.col("__o.cx").alias("cx"), F.col("__o.cy").alias("cy")).drop("__o")
    e = e.withColumn("centre_distance", distance(x, y, "cx", "cy"))
    return e.where((F.col("centre_distance") <= F.lit(radius)) & inside_polygon("cx", "cy", vertices))


def thin_to_grid(candidates: DataFrame, vertices: Sequence[tuple[float, float]], spacing: float, *,
                 key: str, score: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Pick per grid centre the candidate with the smallest (score, distance, key).

    ``candidates`` must already be restricted to the polygon and have
    non-null coordinates.  Returns the chosen candidate rows plus r, c,
    centre_distance, ordered by centre (y, x).  Only narrow rows (centre,
    score, distance, key, row number) are aggregated; the chosen rows are
    joined back.  A candidate that wins two centres (it lies exactly between
    them) keeps the first; the others choose again among what is left, which
    only the centres touched by a lost candidate repeat.
    """
    cols = candidates.columns
    base = candidates.withColumn("__score", score).withColumn("__rid", F.monotonically_increasing_id()).checkpoint()
    m = centre_of(base.select(F.col(key).alias("__key"), "__score", "__rid", F.col(x).alias("__x"),
                              F.col(y).alias("__y")), vertices, spacing, "__x", "__y")
    m = m.select("r", "c", "centre_distance", "__score", "__key", "__rid")

    def choose(rows: DataFrame) -> DataFrame:
        return rows.groupBy("r", "c").agg(
            F.min(F.struct("__score", "centre_distance", "__key", "__rid")).alias("b")).select(
            "r", "c", F.col("b.centre_distance").alias("centre_distance"), F.col("b.__rid").alias("__rid"))

    picks = choose(m).checkpoint()
    lost = None
    while True:  # every round takes at least one candidate from a centre for good
        first = (picks.groupBy("__rid").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r", "c")).alias("first"))
                 .where(F.col("n") > 1))
        gone = (picks.join(first, "__rid").where(F.struct("r", "c") != F.col("first"))
                .select("r", "c", "__rid").checkpoint())
        if gone.isEmpty():
            break
        lost = gone if lost is None else lost.unionByName(gone)
        again = gone.select("r", "c").distinct()
        new = choose(m.join(again, ["r", "c"], "left_semi").join(lost, ["r", "c", "__rid"], "left_anti"))
        picks = picks.join(again, ["r", "c"], "left_anti").unionByName(new).checkpoint()
    return (base.join(picks, "__rid").select(*cols, "r", "c", "centre_distance").orderBy("r", "c"))
