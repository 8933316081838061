"""Delimited point and scope files.

Reading happens in three steps, all per file and all distributed:

1. ``read_lines`` -- ``spark.read.text`` plus a per-file line number from
   the line counts of the file splits (no sort, no copy of the text);
2. ``sniff`` -- the first row of each file, then one aggregate per file over
   all candidate separators (``;``, ``,``, whitespace run, in that order)
   that finds the columns holding any value; the first separator giving an
   acceptable column count wins, the header test looks at the first row's
   last column(s);
3. ``parse_points`` / ``parse_scope`` -- rows are split with the file's
   separator, too-wide rows skipped, columns named by arity, decimal commas
   accepted, ids generated where the file has none, and whole files with a
   non-numeric coordinate rejected.

Tables with one row per file or per file split are broadcast while they have
at most ``SMALL_ROWS`` rows (counted first), so one huge file is not one
reducer; beyond that the same joins are shuffled.

A file without an acceptable layout is never skipped silently: unless bad
files are to be left out, ``BadFileError`` names it.

Files themselves go through ``layout``, which reads their text three times;
the functions here take any table of lines.

``lines`` DataFrames have the columns ``source_file``, ``line_no``, ``value``;
those of ``read_lines`` also ``file_split``, which says that the rows of one
split stand in file order.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import NA_MARKERS, parse_number
from ..operators.numbering import sequential_index

# Candidate separators in the order they are tried.
SEPARATORS = [";", ",", "whitespace"]
UNIT_SEP = "\x1f"     # between the cells of a workbook row
SMALL_ROWS = 100_000  # tables of at most so many rows (about 20 MB) are broadcast
_WORD = 62            # columns per word of the non-empty mask
_QUOTE_FREE = '(?=(?:[^"]*"[^"]*")*[^"]*$)'


class BadFileError(ValueError):
    pass


def _small(df: DataFrame) -> tuple[DataFrame, bool]:
    """A per-file table, stored once, with a broadcast hint if it is small; whether it is."""
    df = df.checkpoint()
    small = df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    return (F.broadcast(df) if small else df), small


def _running(rows: DataFrame, position: str) -> tuple[DataFrame, bool]:
    """Per file split: first ``position`` and the number of rows of the file before the split."""
    per = rows.groupBy("source_file", "file_split").agg(
        F.count(F.lit(1)).alias("__n"), F.min(position).alias("__m0"))
    w = Window.partitionBy("source_file").orderBy("file_split").rowsBetween(Window.unboundedPreceding, -1)
    return _small(per.select("source_file", "file_split", "__m0",
                             F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off")))


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of text files with their 1-based line number per file.

    The id of a row is its partition and place; both scans (the counting one
    and the caller's) cut the same files into the same splits.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = (spark.read.text(paths)
           .select("value", F.col("_metadata.file_path").alias("source_file"),
                   F.col("_metadata.file_block_start").alias("file_split"),
                   F.monotonically_increasing_id().alias("__mid")))
    splits, small = _running(raw, "__mid")
    lines = raw.join(splits, ["source_file", "file_split"]).select(
        "source_file", (F.col("__mid") - F.col("__m0") + F.col("__off") + 1).alias("line_no"), "value",
        "file_split")
    return lines if small else lines.drop("file_split")


def split_fields(value: Column, sep: str) -> Column:
    """Quote-aware split of one line; surrounding quotes removed, ``""`` unescaped.

    Workbook cells (``UNIT_SEP``) are no text layout: quotes belong to them.
    """
    if sep == UNIT_SEP:
        return F.split(value, sep)
    if sep == "whitespace":
        value, plain = F.trim(value), r"\s+"
    else:
        plain = "\\" + sep if sep in ".|" else sep
    quoted = F.transform(F.split(value, plain + _QUOTE_FREE), lambda p: F.regexp_replace(
        F.regexp_replace(p, r'^\s*"(.*)"\s*$', "$1"), '""', '"'))
    return F.when(F.contains(value, F.lit('"')), quoted).otherwise(F.split(value, plain))


def _is_na(c: Column) -> Column:
    return c.isNull() | c.isin(*NA_MARKERS)


def _mask(fields: Column, word: int, width: int) -> Column:
    """Bits of the columns ``word * _WORD ...`` that hold a value."""
    lo, hi = word * _WORD, min((word + 1) * _WORD, width)
    if width <= _WORD:  # few columns: plain generated code
        acc = F.lit(0).cast("long")
        for i in range(lo, hi):
            acc = acc.bitwiseOR(F.when(~_is_na(F.try_element_at(fields, F.lit(i + 1))), F.lit(1 << (i - lo)))
                                .otherwise(F.lit(0)).cast("long"))
        return acc
    idx = F.sequence(F.lit(lo), F.lit(hi - 1))
    return F.aggregate(idx, F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(
        F.when(~_is_na(F.try_element_at(fields, i + 1)),
               F.call_function("shiftleft", F.lit(1).cast("long"), i - lo)).otherwise(F.lit(0).cast("long"))))


def _kept(masks: Sequence[Column]) -> Column:
    """Indexes (0-based) of the set bits of all words."""
    def bits(mask: Column, first: int) -> Column:
        return F.filter(F.sequence(F.lit(first), F.lit(first + _WORD - 1)), lambda i: F.call_function(
            "shiftright", mask, i - first).bitwiseAND(F.lit(1)) == 1)

    parts = [bits(m, w * _WORD) for w, m in enumerate(masks)]
    return F.concat(*parts)


def sniff(lines: DataFrame, kind: str = "points", sep: str = "auto") -> DataFrame:
    """Per file: chosen separator, kept column indexes, first line and its text.

    The first row of a file gives its width per separator; an aggregate then
    ORs the non-empty-column masks of the rows that are not wider.  ``kind``
    is ``points`` (at least two columns) or ``scope`` (two or three).
    Returns source_file, sep, kept (ARRAY<INT>), n_cols, first_line,
    first_value; sep is NULL for a file without an acceptable layout.
    """
    seps = SEPARATORS if sep == "auto" else [sep]
    body = lines.where(F.trim(F.col("value")) != "").select("source_file", "line_no", "value")
    first, _ = _small(body.groupBy("source_file").agg(F.min("line_no").alias("first_line")))
    head = (body.join(first, "source_file").where(F.col("line_no") == F.col("first_line"))
            .select("source_file", "first_line", F.col("value").alias("first_value"),
                    *[F.size(split_fields(F.col("value"), s)).alias(f"__w{i}") for i, s in enumerate(seps)]))
    head, _ = _small(head)
    width = head.agg(F.max(F.greatest(F.lit(0), F.lit(0), *[F.col(f"__w{i}") for i in range(len(seps))]))).first()[0]
    words = range(max(1, -(-(width or 1) // _WORD)))
    # each line is split once per separator; the masks read the arrays
    split = (body.join(head.drop("first_line", "first_value"), "source_file")
             .select("source_file", *[F.when(F.size(f) <= F.col(f"__w{i}"), f).alias(f"__f{i}")
                                      for i, f in enumerate(split_fields(F.col("value"), s) for s in seps)]))
    masks = split.groupBy("source_file").agg(*[
        F.bit_or(F.when(F.col(f"__f{i}").isNotNull(), _mask(F.col(f"__f{i}"), w, width or 1))).alias(f"__m{i}_{w}")
        for i in range(len(seps)) for w in words])
    per_file = masks.join(head, "source_file")
    choice = F.lit(None).cast("struct<sep:string,kept:array<int>>")
    for i in reversed(range(len(seps))):
        kept = _kept([F.coalesce(F.col(f"__m{i}_{w}"), F.lit(0).cast("long")) for w in words])
        ok = (F.size(kept) >= 2) if kind == "points" else F.size(kept).isin(2, 3)
        choice = F.when(ok, F.struct(F.lit(seps[i]).alias("sep"), kept.alias("kept"))).otherwise(choice)
    return per_file.withColumn("__c", choice).select(
        "source_file", F.col("__c.sep").alias("sep"), F.col("__c.kept").alias("kept"),
        F.size(F.col("__c.kept")).alias("n_cols"), "first_line", "first_value")


def _header_flag(kind: str, seps: Sequence[str]) -> Column:
    """Header test on the first row of each file of a ``sniff`` result."""
    fields = _split_any(seps, F.col("first_value"))
    last = F.try_element_at(fields, F.try_element_at(F.col("kept"), F.lit(-1)) + 1)
    if kind == "points":
        return parse_number(last).isNull()
    prev = F.try_element_at(fields, F.try_element_at(F.col("kept"), F.lit(-2)) + 1)
    return parse_number(last).isNull() | parse_number(prev).isNull()


def _split_any(seps: Sequence[str], v: Column) -> Column:
    """Split ``v`` with the separator chosen for the row's file."""
    out = None
    for s in seps:
        e = split_fields(v, s)
        out = F.when(F.col("sep") == s, e) if out is None else out.when(F.col("sep") == s, e)
    return out


def _named(files: Sequence[str], why: str) -> BadFileError:
    return BadFileError(f"{why}: {', '.join(files)}")


def _rows(lines: DataFrame, kind: str, sep: str, header: str | bool, on_bad: str) -> DataFrame:
    """Rows of all files as cell arrays; files without a layout raise or are left out."""
    seps = SEPARATORS if sep == "auto" else [sep]
    chosen = sniff(lines, kind, sep)
    flag = _header_flag(kind, seps) if header == "auto" else F.lit(bool(header))
    chosen, small = _small(chosen.withColumn("header", flag)
                           .withColumn("__w", F.size(_split_any(seps, F.col("first_value"))))
                           .drop("first_value"))
    if on_bad == "fail":
        bad = [r[0] for r in chosen.where(F.col("sep").isNull()).select("source_file").limit(20).collect()]
        if bad:
            raise _named(bad, "no separator gives " + ("two or more" if kind == "points" else "two or three")
                         + " columns in")
    rows = lines.where(F.trim(F.col("value")) != "").join(chosen, "source_file").where(F.col("sep").isNotNull())
    rows = rows.withColumn("__f", _split_any(seps, F.col("value")))
    rows = rows.where((F.size("__f") <= F.col("__w"))
                      & ~(F.col("header") & (F.col("line_no") == F.col("first_line"))))
    cells = F.transform(F.col("kept"), lambda i: F.try_element_at(F.col("__f"), i + 1))
    keep = ["file_split"] if small and "file_split" in rows.columns else []
    return rows.select("source_file", "line_no", cells.alias("cells"), "n_cols", *keep)


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``row_no``: 1-based among the rows of each file, in file order.

    Rows read by ``read_lines`` are in order inside each split and every step
    since was row by row, so counts per split suffice.  Other tables are
    numbered by range partitions.
    """
    if "file_split" in rows.columns:
        at = rows.withColumn("__at", F.monotonically_increasing_id())
        splits, _ = _running(at, "__at")
        return (at.join(splits, ["source_file", "file_split"])
                .withColumn("row_no", F.col("__at") - F.col("__m0") + F.col("__off") + 1)
                .drop("__at", "__m0", "__off", "file_split"))
    rows = sequential_index(rows, ["source_file", "line_no"], out="__idx")
    first, _ = _small(rows.groupBy("source_file").agg(F.min("__idx").alias("__i0")))
    return (rows.join(first, "source_file").withColumn("row_no", F.col("__idx") - F.col("__i0") + 1)
            .drop("__idx", "__i0"))


def _cell(i: int) -> Column:
    c = F.try_element_at(F.col("cells"), F.lit(i + 1))
    return F.when(~_is_na(c), c)


def parse_points(lines: DataFrame, *, has_height: bool = True, sep: str = "auto",
                 header: str | bool = "auto", swap_xy: bool = False, prefix: str = "P",
                 on_bad: str = "fail") -> DataFrame:
    """Point rows: source_file, row_no, id, x, y[, h].

    ``on_bad``: ``'fail'`` raises for a file without a usable layout or with a
    non-numeric coordinate (the reference rejects the whole file), ``'drop'``
    leaves such files out, ``'quarantine'`` leaves out the bad rows only, and
    ``'keep'`` returns them with NULLs (see ``split_bad``).
    """
    rows = _numbered(_rows(lines, "points", sep, header, on_bad))
    need = 4 if has_height else 3
    with_id = F.col("n_cols") >= need
    auto_id = F.concat(F.lit(f"{prefix}_"), F.col("row_no").cast("string"))
    names = ["x", "y", "h"] if has_height else ["x", "y"]
    cols = {"id": F.when(with_id, _cell(0)).otherwise(auto_id)}
    for j, n in enumerate(names):
        cols[n] = F.when(with_id, _cell(j + 1)).otherwise(_cell(j))
    out = rows.select("source_file", "row_no", *[c.alias(n) for n, c in cols.items()])
    if swap_xy:
        out = swap_axes(out)
    out = out.withColumns({n: parse_number(n) for n in names})
    return _validate(out, names, on_bad)


def parse_scope(lines: DataFrame, *, sep: str = "auto", header: str | bool = "auto",
                swap_xy: bool = False, on_bad: str = "fail") -> DataFrame:
    """Scope polygon vertices: source_file, seq, id, x, y (ring order = file order)."""
    rows = _rows(lines, "scope", sep, header, on_bad)
    three = F.col("n_cols") == 3
    out = rows.select("source_file", F.col("line_no").alias("seq"),
                      F.when(three, _cell(0)).alias("id"),
                      F.when(three, _cell(1)).otherwise(_cell(0)).alias("x"),
                      F.when(three, _cell(2)).otherwise(_cell(1)).alias("y"))
    if swap_xy:
        out = swap_axes(out)
    out = out.withColumns({"x": parse_number("x"), "y": parse_number("y")})
    return _validate(out, ["x", "y"], on_bad)


def file_status(points: DataFrame, names: Sequence[str] = ("x", "y", "h")) -> DataFrame:
    """Per file: rows and rows with a missing coordinate or height."""
    bad = F.lit(False)
    for n in names:
        if n in points.columns:
            bad = bad | F.col(n).isNull()
    return points.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"),
                                              F.sum(bad.cast("int")).alias("n_bad"))


def split_bad(points: DataFrame, names: Sequence[str] = ("x", "y", "h")) -> tuple[DataFrame, DataFrame]:
    """(rows with all numbers, rows with one missing) of a table read with ``on_bad='keep'``."""
    bad = F.lit(False)
    for n in names:
        if n in points.columns:
            bad = bad | F.col(n).isNull()
    return points.where(~bad), points.where(bad)


def _validate(out: DataFrame, names: Sequence[str], on_bad: str) -> DataFrame:
    if on_bad not in ("fail", "drop", "quarantine", "keep"):
        raise ValueError("on_bad must be 'fail', 'drop', 'quarantine' or 'keep'")
    if on_bad == "keep":
        return out
    if on_bad == "quarantine":
        return split_bad(out, names)[0]
    status = file_status(out, names).where(F.col("n_bad") > 0)
    if on_bad == "fail":
        bad = [r[0] for r in status.select("source_file").limit(20).collect()]
        if bad:
            raise _named(bad, "non-numeric values in coordinate columns of")
        return out
    return out.join(status.select("source_file"), "source_file", "left_anti")


def swap_axes(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Exchange the values of the x and y columns."""
    return df.withColumns({x: F.col(y), y: F.col(x)})


def extension(path: Column | str) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(p, r"(\.[^./\\]+)$", 1))


def _by_format(paths: str | Sequence[str]) -> tuple[list[str], list[str]]:
    paths = [paths] if isinstance(paths, str) else list(paths)
    if any(p.lower().endswith(".xls") for p in paths):
        raise ValueError("legacy binary .xls workbooks are not supported; save them as .xlsx")
    books = [p for p in paths if p.lower().endswith(".xlsx")]
    return [p for p in paths if p not in books], books


def _bare_path(p: str) -> str:
    return re.sub(r"^[A-Za-z0-9+.-]+:/+", "/", unquote(p))


def _text_lines(spark: SparkSession, paths: Sequence[str], on_bad: str) -> DataFrame:
    """Lines of text files; a file without any line is a bad file."""
    lines = read_lines(spark, paths)
    if on_bad == "fail":
        files = {_bare_path(p): p for p in spark.read.text(paths).inputFiles()}
        seen = {_bare_path(r[0]) for r in lines.where(F.trim(F.col("value")) != "")
                .select("source_file").distinct().collect()}  # one row per input file, listed above anyway
        empty = sorted(files[p] for p in files.keys() - seen)
        if empty:
            raise _named(empty[:20], "no rows in")
    return lines


def read_points(spark: SparkSession, paths: str | Sequence[str], **kw) -> DataFrame:
    """Point files: .xlsx workbooks through ``workbook``, anything else as delimited text."""
    from .layout import read_text
    text, books = _by_format(paths)
    parts = []
    if text:
        rows = read_text(spark, text, "points", **kw)
        parts.append(parse_points(_text_lines(spark, text, kw.get("on_bad", "fail")), **kw) if rows is None else rows)
    if books:
        from .workbook import read_workbook_points
        parts.append(read_workbook_points(spark, books, **kw))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_scope(spark: SparkSession, paths: str | Sequence[str], **kw) -> DataFrame:
    from .layout import read_text
    text, books = _by_format(paths)
    parts = []
    if text:
        rows = read_text(spark, text, "scope", **kw)
        parts.append(parse_scope(_text_lines(spark, text, kw.get("on_bad", "fail")), **kw) if rows is None else rows)
    if books:
        from .workbook import read_workbook_scope
        parts.append(read_workbook_scope(spark, books, **kw))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
