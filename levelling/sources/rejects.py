"""Lines of delimited files that give no good row, with the reason.

``reject_lines`` takes the same tables of lines and the same layout decisions
as ``delimited.parse_points`` and returns one row per line that is no good row:
together with the rows of ``parse_points(on_bad='quarantine')`` every line is
accounted for.  A row's first bad column is named.  Reasons: ``blank``,
``no layout`` (no separator suits the file), ``header``, ``too many cells``
(more than the file's first row), ``missing value`` and ``not a number``.

Lines are classified where they lie: the only join is with the per-file layout.
An empty table of lines gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import parse_number
from .delimited import SEPARATORS, _cell, _header_flag, _small, _split_any, sniff


def reject_lines(lines: DataFrame, *, has_height: bool = True, sep: str = "auto",
                 header: str | bool = "auto") -> DataFrame:
    """``source_file, line_no, column, reason, value`` of all lines that are no good point rows."""
    seps = SEPARATORS if sep == "auto" else [sep]
    chosen = sniff(lines, "points", sep)
    flag = _header_flag("points", seps) if header == "auto" else F.lit(bool(header))
    chosen, _ = _small(chosen.withColumn("header", flag)
                       .withColumn("width", F.size(_split_any(seps, F.col("first_value")))).drop("first_value"))
    rows = lines.join(chosen, "source_file", "left").withColumn(
        "__f", F.when(F.col("sep").isNotNull(), _split_any(seps, F.col("value"))))
    rows = rows.withColumn("cells", F.transform("kept", lambda i: F.try_element_at(F.col("__f"), i + 1)))
    names = ["x", "y", "h"] if has_height else ["x", "y"]
    with_id = F.col("n_cols") >= len(names) + 1
    for j, n in enumerate(names):
        rows = rows.withColumn(f"__{n}", F.when(with_id, _cell(j + 1)).otherwise(_cell(j)))
    bad_column = F.coalesce(*[F.when(parse_number(f"__{n}").isNull(), F.lit(n)) for n in names])
    absent = F.coalesce(*[F.when(parse_number(f"__{n}").isNull(), F.col(f"__{n}").isNull()) for n in names])
    line = (F.when(F.trim("value") == "", "blank").when(F.col("sep").isNull(), "no layout")
            .when(F.col("header") & (F.col("line_no") == F.col("first_line")), "header")
            .when(F.size("__f") > F.col("width"), "too many cells"))
    rows = rows.withColumn("line", line).withColumn("column", F.when(F.col("line").isNull(), bad_column))
    reason = F.coalesce("line", F.when(F.col("column").isNotNull(), F.when(absent, "missing value")
                                       .otherwise("not a number")))
    # a generated row keeps the filter above: below, it would split the line again for every cell it asks for
    found = F.struct("column", reason.alias("reason"))
    return (rows.select("source_file", "line_no", F.explode_outer(F.array(found)).alias("__r"), "value")
            .where("__r.reason is not null").select("source_file", "line_no", "__r.column", "__r.reason", "value"))
