"""Height differences, accuracy flag, result rounding and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import py_round, rint_n, rounded_difference

# Result columns in output order, the flag values and the
# missing-value marker of the text outputs.
RESULT_COLUMNS = [
    "id_odniesienia", "x_odniesienia", "y_odniesienia", "h_odniesienia",
    "diff_h_geoportal", "geoportal_h",
    "id_porownania", "x_porownania", "y_porownania", "h_porownania",
    "diff_h", "odleglosc_pary", "osiaga_dokladnosc",
]
YES, NO = "Tak", "Nie"
MISSING_TEXT = "brak_danych"


def accuracy_flag(diff: Column | str, tolerance: float) -> Column:
    """``Tak`` when ``|diff| <= tolerance`` (inclusive), ``Nie`` otherwise, NULL without a value."""
    d = F.col(diff) if isinstance(diff, str) else diff
    return F.when(d.isNull(), F.lit(None).cast("string")) \
        .when(F.abs(d) <= F.lit(float(tolerance)), F.lit(YES)).otherwise(F.lit(NO))


def is_accurate(flag: Column | str) -> Column:
    """Export predicate: the trimmed, lower-cased flag equals ``tak``; NULL is False."""
    f = F.col(flag) if isinstance(flag, str) else flag
    return F.coalesce(F.lower(F.trim(f)) == F.lit("tak"), F.lit(False))


def add_differences(df: DataFrame, decimals: int, *, file_pair: bool, service: bool) -> DataFrame:
    cols = {}
    if file_pair:
        cols["diff_h"] = rounded_difference("h_odniesienia", "h_porownania", decimals)
    if service:
        cols["diff_h_geoportal"] = rounded_difference("h_odniesienia", "geoportal_h", decimals)
    return df.withColumns(cols) if cols else df


def add_flag(df: DataFrame, *, tolerance: float | None, height_tolerance: float | None,
             file_pair: bool, service: bool) -> DataFrame:
    """Service tolerance decides when a service difference exists (Q3); else file tolerance."""
    if service and height_tolerance is not None:
        flag = accuracy_flag("diff_h_geoportal", height_tolerance)
    elif file_pair and tolerance is not None:
        flag = accuracy_flag("diff_h", tolerance)
    else:
        flag = F.lit(None).cast("string")
    return df.withColumn("osiaga_dokladnosc", flag)


def round_result(df: DataFrame, decimals: int) -> DataFrame:
    """Output rounding of the result columns that exist."""
    rules = {
        "x_odniesienia": rint_n("x_odniesienia", 2),
        "y_odniesienia": rint_n("y_odniesienia", 2),
        "h_odniesienia": rint_n("h_odniesienia", decimals),
        "geoportal_h": rint_n("geoportal_h", 1),
        "diff_h_geoportal": rint_n("diff_h_geoportal", decimals),
        "x_porownania": rint_n("x_porownania", 2),
        "y_porownania": rint_n("y_porownania", 2),
        "h_porownania": rint_n("h_porownania", decimals),
        "diff_h": rint_n("diff_h", decimals),
        "odleglosc_pary": py_round("odleglosc_pary", 3),
    }
    return df.withColumns({c: e for c, e in rules.items() if c in df.columns})


def sort_by_abs(df: DataFrame, column: str, tie: str = "id_odniesienia") -> DataFrame:
    """Largest absolute difference first, missing last; ties by ``tie``."""
    return df.orderBy(F.abs(F.col(column)).desc_nulls_last(), F.col(tie).asc_nulls_last())


def select_result(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    return df.select(*[c for c in RESULT_COLUMNS if c in df.columns], *(extra or []))
