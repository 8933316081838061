"""Text to number conversion and coordinate structure tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain decimal or exponent notation, optional sign, optional
# surrounding blanks.  Spark's own cast also accepts ``1d``, ``1.5f``, ``NaN``
# and ``Infinity``; the loaders reject those.
NUMERIC_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# The default missing-value markers of the pandas CSV reader.
# A cell holding exactly one of these reads as missing, ids included.
NA_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

_INF = float("inf")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decimal_text(c: Column | str) -> Column:
    """Decimal comma to decimal point."""
    return F.replace(_col(c), F.lit(","), F.lit("."))


def parse_number(c: Column | str) -> Column:
    """Text (decimal comma allowed) to DOUBLE; anything else to NULL.

    Infinite values count as unparsable.
    """
    s = decimal_text(c)
    v = F.when(s.rlike(NUMERIC_TEXT), F.trim(s).try_cast("double"))
    return F.when(F.abs(v) < F.lit(_INF), v)


def is_number_text(c: Column | str) -> Column:
    """True when the text parses as a finite number, NULL text included as False."""
    return F.coalesce(parse_number(c).isNotNull(), F.lit(False))


def na_to_null(c: Column | str) -> Column:
    """Missing-value markers to NULL, other text unchanged."""
    c = _col(c)
    return F.when(~c.isin(*NA_MARKERS), c)


def has_easting_structure(c: Column | str) -> Column:
    """Integer part has seven digits and starts with 5, 6, 7 or 8.

    ``int()`` truncates toward zero, as does the cast; NaN and infinities
    give NULL through ``try_cast`` and count as False.
    """
    t = _col(c).try_cast("bigint")
    return F.coalesce(t.between(5000000, 8999999), F.lit(False))


def zone_of(easting: Column | str) -> Column:
    """Zone number 5..8 of a PL-2000 easting, NULL when it has no zone shape."""
    t = _col(easting).try_cast("bigint")
    return F.when(t.between(5000000, 8999999), F.floor(t / F.lit(1000000)).cast("int"))


def source_epsg(easting: Column | str) -> Column:
    """EPSG code 2176..2179 of a PL-2000 easting, NULL otherwise."""
    return (F.lit(2171) + zone_of(easting)).cast("int")
