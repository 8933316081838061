"""Hierarchical index of points for nearest-neighbour searches.

Points are sorted along a Morton curve (range partitions, no single-task sort)
and cut into leaves of ``LEAF`` consecutive points with tight bounding boxes;
``FAN`` consecutive nodes form a node of the next level, up to one root.  Every
row of an index table holds a bounded array: a leaf its points, a node the
numbers and boxes of its children.

``descend`` searches it in two passes of equi-joins on the node number.  The
first follows the closest child (of equally close ones that of the row's own
Morton code, clipped to the box of the points) from the root to one leaf; the
best point there, and the boxes beside the leaf, bound the distance.  For a row
far from all points that is a leaf on the side that faces it: its own code alone
would lead to any leaf there, and all along that side would stay in question.
The second visits all nodes whose box may hold something closer.  A row so meets
the few leaves that can hold its answer, wherever it lies; nothing is grouped
between the levels.  Node tables are broadcast while
they take at most ``BROADCAST_NODE_BYTES`` (known from the number of points);
larger ones are joined by a shuffle, whose skewed partitions Spark splits.

The computed distance to a box never exceeds the computed distance to a point
in it (all steps round monotonically), so no bound drops an answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import distance
from .numbering import sequential_index

LEAF = 8
FAN = 32
BITS = 31                          # of a Morton code per axis
BROADCAST_NODE_BYTES = 32 << 20
_CHILD_BYTES = 72                  # a child's number and box in a row
_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
           (2, 0x3333333333333333), (1, 0x5555555555555555)]


def with_morton(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float], out: str) -> DataFrame:
    """Add the interleaved bits of both coordinates, scaled to the box (x0, y0, x1, y1)."""
    span = max(box[2] - box[0], box[3] - box[1])
    top = (1 << BITS) - 1
    for name, c, low in (("__mx", x, box[0]), ("__my", y, box[1])):
        cell = F.floor((F.col(c) - F.lit(float(low))) / F.lit(float(span)) * F.lit(float(top))) if span > 0 else F.lit(0)
        df = df.withColumn(name, F.least(F.greatest(cell.cast("long"), F.lit(0)), F.lit(top)))
    for shift, mask in _SPREAD:
        df = df.withColumns({n: F.col(n).bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
                             for n in ("__mx", "__my")})
    return df.withColumn(out, F.col("__mx").bitwiseOR(F.shiftleft("__my", 1))).drop("__mx", "__my")


@dataclass(frozen=True)
class Tree:
    """``leaves``: no, pts; ``root``: the children of the root; ``levels``: no, kids, from the leaves up to below it."""
    leaves: DataFrame
    root: Column
    box: tuple[float, float, float, float]
    levels: list[DataFrame]
    widths: list[int]              # nodes per level
    leaf_bytes: float


_BOX = ("x0", "y0", "x1", "y1")
_LOW, _HIGH = -1, 1 << 62


def _shares() -> Column:
    """Children of a node in Morton order, each with its share lo <= code < hi of all codes."""
    def share(k: Column, i: Column) -> Column:
        nxt = F.try_element_at("kids", (i + 2).cast("int"))
        return F.struct(k["no"].alias("no"), *[k[c].alias(c) for c in _BOX],
                        F.when(i == 0, F.lit(_LOW)).otherwise(k["lo"]).alias("lo"),
                        F.coalesce(nxt["lo"], F.lit(_HIGH)).alias("hi"))
    return F.transform("kids", share)


def build(points: DataFrame, x: str, y: str, fields: Sequence[tuple[str, str]], count: int,
          box: tuple[float, float, float, float], row_bytes: float) -> Tree:
    """Index of ``count`` points (distinct, finite coordinates); ``fields``: (name in ``pts``, column)."""
    order = sequential_index(with_morton(points, x, y, box, "__code"), ["__code", x, y], out="__pos", start=0)
    item = F.struct(F.col(x).alias("x"), F.col(y).alias("y"), *[F.col(c).alias(n) for n, c in fields])
    leaves = (order.groupBy(F.floor(F.col("__pos") / LEAF).alias("no"))
              .agg(F.collect_list(item).alias("pts"), F.min(x).alias("x0"), F.min(y).alias("y0"),
                   F.max(x).alias("x1"), F.max(y).alias("y1"), F.min("__code").alias("lo")).checkpoint())
    levels, widths, below, n = [], [], leaves, -(-count // LEAF)
    while not widths or n > 1:
        node = F.floor(F.col("no") / FAN).alias("no")
        below = (below.groupBy(node).agg(
            F.sort_array(F.collect_list(F.struct("no", "lo", *_BOX))).alias("kids"),
            F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
            F.min(below["lo"]).alias("lo")).withColumn("kids", _shares()).checkpoint())
        n = -(-n // FAN)
        levels.append(below.select("no", "kids"))
        widths.append(n)
    top = levels.pop().first()["kids"]     # at most FAN children
    root = F.array(*[F.struct(*[F.lit(k[c]).cast("double").alias(c) for c in _BOX],
                              *[F.lit(k[c]).cast("long").alias(c) for c in ("no", "lo", "hi")]) for k in top])
    return Tree(leaves.select("no", "pts"), root, box, levels, widths[:-1], LEAF * row_bytes * -(-count // LEAF))


def box_distance(x: Column, y: Column, box: Column) -> Column:
    """Distance of a point to a box, 0 inside."""
    dx = F.greatest(box["x0"] - x, F.lit(0.0), x - box["x1"])
    dy = F.greatest(box["y0"] - y, F.lit(0.0), y - box["y1"])
    return F.sqrt(dx * dx + dy * dy)


def certain_distance(x: Column, y: Column, box: Column) -> Column:
    """A distance within which a tight box (a point on each side) holds a point for certain."""
    near_x = F.when(x <= (box["x0"] + box["x1"]) / 2, box["x0"]).otherwise(box["x1"])
    near_y = F.when(y <= (box["y0"] + box["y1"]) / 2, box["y0"]).otherwise(box["y1"])
    far_x = F.when(F.abs(x - box["x0"]) >= F.abs(x - box["x1"]), box["x0"]).otherwise(box["x1"])
    far_y = F.when(F.abs(y - box["y0"]) >= F.abs(y - box["y1"]), box["y0"]).otherwise(box["y1"])
    return F.least(distance(x, y, near_x, far_y), distance(x, y, far_x, near_y))


def closest(pts: Column, x: Column, y: Column, fields: Sequence[str]) -> Column:
    """Best of an array of points: struct (d, fields..., x, y), the smallest in this order."""
    return F.array_min(F.transform(pts, lambda p: F.struct(
        distance(x, y, p["x"], p["y"]).alias("d"), p[fields[0]].alias(fields[0]), p["x"].alias("x"),
        p["y"].alias("y"), *[p[f].alias(f) for f in fields[1:]])))


def _join(rows: DataFrame, nodes: DataFrame, size: float) -> DataFrame:
    if size <= BROADCAST_NODE_BYTES:
        nodes = F.broadcast(nodes)
    return rows.join(nodes.withColumnRenamed("no", "__no"), F.col("__node") == F.col("__no")).drop("__no")


def descend(tree: Tree, rows: DataFrame, x: str, y: str, fields: Sequence[str], limit: float,
            keep: Sequence[str] = ()) -> DataFrame:
    """``x, y, *keep, __best, __seen`` of rows (finite coordinates) with a point within ``limit`` (0: none).

    ``__seen`` counts the points that the row was compared with.
    """
    px, py = F.col(x), F.col(y)
    cols = [x, y, *keep]
    down = list(zip(reversed(tree.levels), reversed(tree.widths)))

    def first_kid(met: DataFrame, kids: Column) -> DataFrame:
        code, own = F.col("__code"), F.col("own")
        sure = F.array_min(F.transform(kids, lambda k: certain_distance(px, py, k))).alias("__sure")
        held = [F.col("kids")] if "kids" in met.columns else []  # the root's children are a literal
        nearest = F.array_min(F.transform(kids, lambda k: F.struct(
            box_distance(px, py, k).alias("d"), ((code < k["lo"]) | (code >= k["hi"])).alias("other"), k["no"].alias("no"))))
        return (met.select(*cols, "__code", sure, *held, F.explode(
            F.filter(kids, lambda k: (code >= k["lo"]) & (code < k["hi"]))).alias("own"))
            .select(*cols, "__code", "__sure", F.coalesce(F.when(box_distance(px, py, own) > 0, nearest["no"]),
                                                          own["no"], F.lit(-1)).alias("__node")))
    # a fixed number of partitions: the rows are few bytes each, but many steps of work
    near = first_kid(with_morton(rows, x, y, tree.box, "__code").repartition(
        int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), x, y), tree.root)
    for nodes, width in down:
        near = first_kid(_join(near, nodes, width * FAN * _CHILD_BYTES), F.col("kids"))
    found = _join(near, tree.leaves, tree.leaf_bytes).select(
        *cols, F.least("__sure", closest(F.col("pts"), px, py, fields)["d"]).alias("__bound"),
        F.size("pts").alias("__first"))
    if limit > 0:
        found = found.withColumn("__bound", F.least("__bound", F.lit(float(limit))))
    cols += ["__bound", "__first"]

    def open_kids(met: DataFrame, kids: Column) -> DataFrame:
        return (met.select(*cols, F.explode(kids).alias("k"))
                .where(box_distance(px, py, F.col("k")) <= F.col("__bound")).select(*cols, F.col("k.no").alias("__node")))
    open_ = open_kids(found, tree.root)
    for nodes, width in down:
        open_ = open_kids(_join(open_, nodes, width * FAN * _CHILD_BYTES), F.col("kids"))
    best = _join(open_, tree.leaves, tree.leaf_bytes).select(
        *cols, closest(F.col("pts"), px, py, fields).alias("__best"), F.size("pts").alias("__n"))
    return (best.groupBy(x, y, *keep).agg(
        F.min(F.when(F.col("__best.d") <= F.col("__bound"), F.col("__best"))).alias("__best"),
        (F.sum("__n") + F.first("__first")).alias("__seen")).where("__best is not null"))
