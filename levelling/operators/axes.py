"""Axis conventions and zones.

The reference decides the axis order of a whole table from its first row.
Here "first" is the smallest value of an explicit order column (a file row
number or a key); the decision is one small aggregate whose single row is
read on the driver, then applied as literal column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import has_easting_structure, source_epsg, zone_of


@dataclass(frozen=True)
class Roles:
    northing: str  # column holding the geodetic northing
    easting: str   # column holding the geodetic easting


def _looks_like_easting(v) -> bool:
    try:
        t = int(v)
    except (TypeError, ValueError, OverflowError):
        return False
    return 5000000 <= t <= 8999999


def order_of(order: str | Sequence[str]) -> Column:
    """One comparable column for an order given as a name or several names."""
    return F.col(order) if isinstance(order, str) else F.struct(*order)


def first_row(df: DataFrame, order: str | Sequence[str], cols: list[str]):
    """Values of ``cols`` on the row with the smallest ``order`` (None if empty)."""
    r = df.agg(F.min_by(F.struct(*cols), order_of(order)).alias("r")).first()
    return None if r is None or r["r"] is None else r["r"]


def roles_from_first(fx, fy, x: str = "x", y: str = "y") -> Roles:
    if _looks_like_easting(fy):
        return Roles(northing=x, easting=y)
    if _looks_like_easting(fx):
        return Roles(northing=y, easting=x)
    return Roles(northing=x, easting=y)


def detect_roles(df: DataFrame, order: str | Sequence[str], x: str = "x", y: str = "y") -> Roles:
    """Axis roles decided by the first row (parity with the reference, Q1)."""
    r = first_row(df, order, [x, y])
    if r is None:
        return Roles(northing=x, easting=y)
    return roles_from_first(r[0], r[1], x, y)


def roles_per_file(df: DataFrame, by: str, order: str | Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Add ``geodetic_northing`` / ``geodetic_easting``, decided by the first row of each ``by``.

    One map-side-combined aggregate gives a row per file; Spark joins that
    small table back by its measured size.
    """
    first = df.groupBy(by).agg(F.min_by(F.struct(F.col(x).alias("x"), F.col(y).alias("y")), order_of(order)).alias("f"))
    swap = first.select(F.col(by).alias("__by"), (~has_easting_structure("f.y") & has_easting_structure("f.x"))
                        .alias("__swap"))
    out = df.join(swap, F.col(by).eqNullSafe(F.col("__by")), "left")
    return out.withColumns({
        "geodetic_northing": F.when(F.col("__swap"), F.col(y)).otherwise(F.col(x)),
        "geodetic_easting": F.when(F.col("__swap"), F.col(x)).otherwise(F.col(y)),
    }).drop("__by", "__swap")


def assign_roles(df: DataFrame, order: str, x: str = "x", y: str = "y",
                 strict: bool = False) -> DataFrame:
    """Add ``geodetic_northing`` / ``geodetic_easting``.

    ``strict=True`` decides per row instead of from the first row (opt-in,
    not the reference behaviour): the coordinate that looks like a PL-2000
    easting and is not a plausible northing (> 6.2 M) is the easting.
    """
    if strict:
        ey = has_easting_structure(y) & (F.col(y) > F.lit(6200000.0))
        ex = has_easting_structure(x) & (F.col(x) > F.lit(6200000.0))
        swap = ~ey & ex
        return df.withColumns({
            "geodetic_northing": F.when(swap, F.col(y)).otherwise(F.col(x)),
            "geodetic_easting": F.when(swap, F.col(x)).otherwise(F.col(y)),
        })
    roles = detect_roles(df, order, x, y)
    return df.withColumns({"geodetic_northing": F.col(roles.northing),
                           "geodetic_easting": F.col(roles.easting)})


def with_zone(df: DataFrame, easting: str = "geodetic_easting") -> DataFrame:
    """Add ``zone`` (5..8) and ``epsg`` (2176..2179), NULL when unknown."""
    return df.withColumns({"zone": zone_of(easting), "epsg": source_epsg(easting)})


def zone_counts(df: DataFrame, easting: str = "geodetic_easting") -> DataFrame:
    """Rows per source EPSG code (unknown zone dropped)."""
    return (df.select(source_epsg(easting).alias("epsg")).where(F.col("epsg").isNotNull())
            .groupBy("epsg").agg(F.count(F.lit(1)).alias("n_points")))


def first_row_decision(df: DataFrame, order: str | Sequence[str], x: str = "x",
                       y: str = "y") -> tuple[Roles, int | None]:
    """Axis roles and EPSG code (None if unknown) of the first row, read once."""
    r = first_row(df, order, [x, y])
    if r is None:
        return Roles(northing=x, easting=y), None
    roles = roles_from_first(r[0], r[1], x, y)
    e = r[1] if roles.easting == y else r[0]
    return roles, 2171 + int(e) // 1000000 if _looks_like_easting(e) else None


def first_row_epsg(df: DataFrame, order: str | Sequence[str], x: str = "x", y: str = "y"):
    """EPSG code of the first row after role assignment (None if unknown)."""
    return first_row_decision(df, order, x, y)[1]


class ZoneMismatch(ValueError):
    pass


def check_zones(points: DataFrame, points_order: str | Sequence[str], scope: DataFrame,
                scope_order: str | Sequence[str],
                x: str = "x", y: str = "y") -> tuple[int | None, int | None]:
    """Compare the first-row zones of points and scope; raise if both known and different."""
    a = first_row_epsg(points, points_order, x, y)
    b = first_row_epsg(scope, scope_order, x, y)
    if a is not None and b is not None and a != b:
        raise ZoneMismatch(f"points are in EPSG:{a} but the scope polygon is in EPSG:{b}")
    return a, b
