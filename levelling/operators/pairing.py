"""Nearest-neighbour pairing of two point tables.

Every row of ``left`` gets the closest row of ``right`` on planar Euclidean
distance; ties go to the smaller right id.  Rows with no right point within
``max_distance`` (inclusive) keep NULL pair columns; with ``max_distance == 0``
the search has no limit.  No column needs to identify left rows.

Two plans, chosen from counts taken in one job over both inputs:

* **Cells** (never more than ``DENSE_CANDIDATES`` distinct right points in a 3x3
  block of cells).  The side of a cell is ``max_distance``; without a limit it
  follows the mean density, and rows with nothing that near go on to the tree.  Right points are
  copied to the nine cells around their own and collected to one row per cell,
  an array of bounded length; every left row joins the row of its own cell and
  takes the minimum over the array in place.  No candidate row is ever made,
  aggregated or joined back, and no left row is shuffled when the cells take at
  most ``BROADCAST_COPY_BYTES`` (counted before) and are broadcast.  When the
  right side has more than twice the left's rows, only right points near an
  occupied left cell are copied.
* **Tree** (dense or clustered data, or a cell with more than ``HOT_ROWS`` left
  rows).  Equal left coordinates are collapsed, the right points are indexed
  (``operators.tree``), each distinct left coordinate descends to the leaves
  that can hold its answer, and answers are joined back on the coordinates.

Exact coordinate duplicates on the right collapse to the smallest id first (a
map-side-combined aggregate); they cannot win anyway.  Joins are inner, or left
outer from the left rows, so that Spark may split skewed partitions of left
rows.

``mutual_pairs`` needs one join only: cells of left points meet the blocks of
right points, each row yields the best right point of its left points and the
best left point of its right points, and both meet again in one aggregate by
right point.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tree import build, closest, descend

DENSE_CANDIDATES = 256
HOT_ROWS = 50_000
# The cells are broadcast (and the left rows stay where they lie) when their
# nine copies of every point take at most this many bytes: rows of fixed width
# plus the text they carry, both counted before the join is planned.
BROADCAST_COPY_BYTES = 96 << 20
_ROW_BYTES = 72

# Types whose values take the same few bytes in every row.
_FIXED = {"byte", "short", "integer", "long", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz"}

_OFFSETS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]


def _located(x: str, y: str) -> Column:
    """True when both coordinates are finite numbers."""
    inf = F.lit(float("inf"))

    def finite(c):
        v = F.col(c).cast("double")
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf)
    return finite(x) & finite(y)


@dataclass(frozen=True)
class PairColumns:
    """Names of the columns added to the left table."""
    id: str = "id_porownania"
    x: str = "x_porownania"
    y: str = "y_porownania"
    distance: str = "odleglosc_pary"


@dataclass(frozen=True)
class Side:
    """What the choice of the plan needs to know of one table."""
    rows: int = 0
    peak: int = 0                  # rows of the fullest cell
    box: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    row_bytes: float = _ROW_BYTES


def _points(df: DataFrame, rid: str, rx: str, ry: str, payload: Sequence[str] = ()) -> DataFrame:
    """One row per distinct coordinate (rx, ry), carrying the smallest id."""
    best = F.min(F.struct(F.col(rid).alias("id"), *[F.col(c).alias(f"p{n}") for n, c in enumerate(payload)]))
    g = (df.where(_located(rx, ry)).groupBy(F.col(rx).alias("rx"), F.col(ry).alias("ry")).agg(best.alias("r")))
    return g.select("rx", "ry", "r.*")


def _cell(x: str, y: str, size: float) -> list[Column]:
    far = F.lit(1 << 60)            # coordinates beyond share a cell, so that neighbours stay in range
    return [F.greatest(F.least(F.floor(F.col(c) / F.lit(float(size))), far), -far).alias(g)
            for c, g in ((x, "gx"), (y, "gy"))]


def _measure(sides: Sequence[tuple[DataFrame, str, str, Sequence[str]]], size: float) -> list[Side]:
    """Row counts, fullest cell, box and width of tables (df, x, y, carried columns), in one job."""
    def text_bytes(df: DataFrame, cols: Sequence[str]) -> Column:
        found = [c for c in cols if df.schema[c].dataType.typeName() not in _FIXED]
        return sum([F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in found], F.lit(0))
    both = None
    for s, (df, x, y, cols) in enumerate(sides):
        part = df.select(F.lit(s).alias("s"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
                         text_bytes(df, cols).alias("b"))
        both = part if both is None else both.unionByName(part)
    per_cell = (both.where(_located("x", "y")).groupBy("s", *_cell("x", "y", size)).agg(
        F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.min("y").alias("y0"), F.max("y").alias("y1")))
    stats = {r["s"]: r for r in per_cell.groupBy("s").agg(
        F.sum("n").alias("n"), F.sum("b").alias("b"), F.max("n").alias("peak"), F.min("x0").alias("x0"),
        F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")).collect()}
    return [Side(stats[s]["n"], stats[s]["peak"], (stats[s]["x0"], stats[s]["y0"], stats[s]["x1"], stats[s]["y1"]),
                 _ROW_BYTES + stats[s]["b"] / stats[s]["n"]) if s in stats else Side() for s in range(len(sides))]


def _blocks(pts: DataFrame, size: float, fields: Sequence[str], near: DataFrame | None = None) -> DataFrame:
    """Per cell (gx, gy) the points of the cell and the eight around it."""
    cells = F.explode(F.array(*[F.struct((F.col("gx") + dx).alias("gx"), (F.col("gy") + dy).alias("gy"))
                                for dx, dy in _OFFSETS])).alias("c")
    copies = pts.select(*_cell("rx", "ry", size), "rx", "ry", *fields).select(cells, "rx", "ry", *fields).select(
        "c.gx", "c.gy", "rx", "ry", *fields)
    if near is not None:
        copies = copies.join(near, ["gx", "gy"], "left_semi")
    return copies.groupBy("gx", "gy").agg(F.collect_list(F.struct(
        F.col("rx").alias("x"), F.col("ry").alias("y"), *fields)).alias("pts"))


def _best_type(pts: DataFrame, fields: Sequence[str]) -> str:
    t = {n: pts.schema[n].dataType.simpleString() for n in ("rx", "ry", *fields)}
    rest = "".join(f",{f}:{t[f]}" for f in fields[1:])
    return f"struct<d:double,{fields[0]}:{t[fields[0]]},x:{t['rx']},y:{t['ry']}{rest}>"


def _typical_cell(side: Side) -> float:
    """Cell size that gives five points to a cell at the mean density."""
    x0, y0, x1, y1 = side.box
    area = (x1 - x0) * (y1 - y0)
    return math.sqrt(5.0 * area / side.rows) if 0 < area < math.inf else 1.0


def _by_cells(left: DataFrame, rpts: DataFrame, x: str, y: str, fields: Sequence[str], size: float, lside: Side,
              rside: Side) -> DataFrame:
    """Left rows with ``__best`` (null if none within ``size``) and ``__seen``, by cells."""
    cells = left.where(_located(x, y)).select(*_cell(x, y, size)).distinct() if rside.rows > 2 * lside.rows else None
    blocks = _blocks(rpts, size, fields, cells)
    if 9 * rside.rows * rside.row_bytes <= BROADCAST_COPY_BYTES:
        blocks = F.broadcast(blocks)
    gx, gy = _cell(x, y, size)
    return (left.withColumns({"__gx": gx, "__gy": gy})
            .join(blocks.select(F.col("gx").alias("__cx"), F.col("gy").alias("__cy"), F.col("pts").alias("__pts")),
                  (F.col("__gx") == F.col("__cx")) & (F.col("__gy") == F.col("__cy")) & _located(x, y), "left")
            .withColumn("__best", closest(F.col("__pts"), F.col(x), F.col(y), fields))
            .withColumn("__seen", F.coalesce(F.greatest(F.size("__pts"), F.lit(0)), F.lit(0)))
            .withColumn("__best", F.when(F.col("__best.d") <= F.lit(size), F.col("__best")))
            .drop("__gx", "__gy", "__cx", "__cy", "__pts"))


def _by_tree(left: DataFrame, rpts: DataFrame, x: str, y: str, fields: Sequence[str], limit: float,
             rside: Side) -> DataFrame:
    """Left rows with ``__best`` (null if none within ``limit``; 0: no limit) and ``__seen``, by the index."""
    tree = build(rpts, "rx", "ry", [(f, f) for f in fields], rside.rows, rside.box, rside.row_bytes)
    spots = left.where(_located(x, y)).select(F.col(x).alias("__sx"), F.col(y).alias("__sy")).distinct()
    best = descend(tree, spots, "__sx", "__sy", fields, limit)
    return (left.join(best, (F.col(x) == F.col("__sx")) & (F.col(y) == F.col("__sy")), "left").drop("__sx", "__sy")
            .withColumn("__seen", F.coalesce("__seen", F.lit(0)).cast("int")))


def nearest_pair(left: DataFrame, right: DataFrame, max_distance: float, *, x: str = "x", y: str = "y",
                 right_id: str = "id", right_x: str = "x", right_y: str = "y",
                 right_payload: Sequence[str] = (), payload_out: Sequence[str] | None = None,
                 names: PairColumns = PairColumns(), seen: str | None = None) -> DataFrame:
    """Left rows with their nearest right point (``max_distance == 0``: no limit).

    Rows without finite coordinates keep NULL pair columns.  Added columns:
    ``names.id/x/y``, ``payload_out`` (the right payload columns, in order) and
    ``names.distance`` (unrounded); ``seen``: how many right points the row was
    compared with.
    """
    if not 0 <= max_distance < math.inf:
        raise ValueError("max_distance must be a number >= 0")
    payload = list(right_payload)
    payload_out = list(payload_out) if payload_out is not None else [f"{names.id}_{c}" for c in payload]
    if len(payload_out) != len(payload):
        raise ValueError("payload_out must name every payload column")
    fields = ["id", *[f"p{n}" for n in range(len(payload))]]
    rpts = _points(right, right_id, right_x, right_y, payload).checkpoint()
    size = float(max_distance) if max_distance > 0 else 1.0
    sides = [(left, x, y, []), (rpts, "rx", "ry", fields)]
    lside, rside = _measure(sides, size)
    if max_distance == 0 and rside.rows:
        size = _typical_cell(rside)
        lside, rside = _measure(sides, size)

    if rside.rows == 0:
        out = left.withColumn("__best", F.lit(None).cast(_best_type(rpts, fields))).withColumn("__seen", F.lit(0))
    elif 9 * rside.peak <= DENSE_CANDIDATES and lside.peak <= HOT_ROWS:
        out = _by_cells(left, rpts, x, y, fields, size, lside, rside)
        if max_distance == 0:      # a best point within the cell size is final
            out = out.checkpoint()
            alone = F.col("__best").isNull() & _located(x, y)
            if not out.where(alone).isEmpty():
                rest = _by_tree(out.where(alone).select(*left.columns), rpts, x, y, fields, 0.0, rside)
                out = out.where(~alone).unionByName(rest)
    else:
        out = _by_tree(left, rpts, x, y, fields, max_distance, rside)

    b = F.col("__best")
    cols = {names.id: b["id"], names.x: b["x"], names.y: b["y"], **{c: b[f"p{n}"] for n, c in enumerate(payload_out)},
            names.distance: b["d"]}
    if seen:
        cols[seen] = F.col("__seen")
    return out.withColumns(cols).drop("__best", "__seen")


def mutual_pairs(left: DataFrame, right: DataFrame, max_distance: float, *, left_key: str, right_key: str,
                 x: str = "x", y: str = "y") -> DataFrame:
    """Pairs that are each other's nearest point (ties by distance, then id).

    Returns ``left_key``, ``right_key`` (as ``<right_key>_r``) and ``distance``.
    """
    if not 0 <= max_distance < math.inf:
        raise ValueError("max_distance must be a number >= 0")
    lpts = _points(left, left_key, x, y).checkpoint()
    rpts = _points(right, right_key, x, y).checkpoint()
    size = float(max_distance) if max_distance > 0 else 1.0
    lside, rside = _measure([(lpts, "rx", "ry", ["id"]), (rpts, "rx", "ry", ["id"])], size)
    names = F.col("l").alias(left_key), F.col("r").alias(f"{right_key}_r"), F.col("d").alias("distance")
    if not (max_distance > 0 and 9 * max(lside.peak, rside.peak) <= DENSE_CANDIDATES):
        cols = PairColumns("r", "x", "y", "d")
        fwd = nearest_pair(lpts.select("rx", "ry", F.col("id").alias("l")), rpts, max_distance, x="rx", y="ry",
                           right_x="rx", right_y="ry", names=cols).where("r is not null").select("l", "r", "d")
        asked = rpts.join(fwd.select(F.col("r").alias("id")).distinct(), "id", "left_semi")
        back = nearest_pair(asked.select("rx", "ry", F.col("id").alias("of")), lpts, max_distance, x="rx", y="ry",
                            right_x="rx", right_y="ry", names=cols)
        back = back.select(F.col("of").alias("r"), F.col("r").alias("l"))
        return fwd.join(back, ["l", "r"]).select(*names)
    # a fixed number of partitions: cells are narrow rows, but each compares all its points
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    homes = (lpts.select(*_cell("rx", "ry", size), "rx", "ry", "id").repartition(parts, "gx", "gy")
             .groupBy("gx", "gy").agg(
        F.collect_list(F.struct(F.col("rx").alias("x"), F.col("ry").alias("y"), "id")).alias("own")))
    blocks = _blocks(rpts, size, ["id"])
    if 9 * rside.rows * rside.row_bytes <= BROADCAST_COPY_BYTES:
        blocks = F.broadcast(blocks)

    def best_of(these: str, those: str) -> Column:
        """Per point of one array its id and the best point of the other."""
        return F.transform(these, lambda p: F.struct(
            p["id"].alias("of"), closest(F.col(those), p["x"], p["y"], ["id"]).alias("best")))
    met = homes.join(blocks, ["gx", "gy"])
    rows = met.select(F.explode(F.concat(
        F.transform(best_of("own", "pts"), lambda e: F.struct(
            F.lit(True).alias("fwd"), e["of"].alias("l"), e["best"]["id"].alias("r"), e["best"]["d"].alias("d"))),
        F.transform(best_of("pts", "own"), lambda e: F.struct(
            F.lit(False).alias("fwd"), e["best"]["id"].alias("l"), e["of"].alias("r"), e["best"]["d"].alias("d"))))
    ).alias("e")).select("e.*").where(F.col("d") <= F.lit(size))
    # by right point: its best left point, and the left points that chose it (at most those of a 3x3 block)
    return (rows.groupBy("r").agg(
        F.min(F.when(~F.col("fwd"), F.struct("d", "l"))).alias("back"),
        F.collect_set(F.when(F.col("fwd"), F.col("l"))).alias("chosen"))
        .where(F.array_contains("chosen", F.col("back.l"))).select("r", "back.l", "back.d").select(*names))
