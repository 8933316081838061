"""Delimited files in three reads of their text.

``delimited.parse_points`` takes any table of lines.  Real files are read here:

1. *State*: one hash aggregate per (file, split, separator, width) holds the
   number of lines, the first place and the columns with a value.  The split's
   counts number the lines, the width of the smallest place is that of the
   file's first row, and the masks of the rows that are not wider give the
   separator and its columns: the layout of all files comes from this table,
   which has a few rows per split whatever the number of lines.
2. *Status*: one row per file, whether its first row is a header and how many
   rows have a coordinate that is no number.
3. The rows themselves.  Their numbers follow from the state: no sort, and no
   count of the rows that stay.

Columns beyond ``WORD`` go to further words of the mask, so width is unlimited.
The state is broadcast up to ``delimited.SMALL_ROWS`` rows, counted first; with
more splits than that the caller falls back to ``delimited.parse_points``.
All reads cut the same files into the same splits, the rows of a split stand in
file order, and the place of a row in its split does not depend on the task that
reads it, so a lost executor changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import parse_number
from .delimited import SEPARATORS, SMALL_ROWS, _bare_path, _cell, _is_na, _named, _split_any, split_fields, swap_axes

WORD = 62    # columns per word of the mask of columns with a value
BLANK = -1   # separator number of blank lines


def _stored(df: DataFrame) -> DataFrame:
    """A small table kept in the checkpoint folder."""
    return df.checkpoint()


def _raw(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("file_split"), F.monotonically_increasing_id().alias("mid"))


def _filled(fields: Column, word: Column) -> Column:
    """Bits of the columns of one word that hold a value."""
    cells = F.slice(fields, (word * WORD + 1).cast("int"), F.lit(WORD))
    bits = F.transform(cells, lambda c, i: F.when(_is_na(c), F.lit(0).cast("long")).otherwise(
        F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def layout_state(raw: DataFrame, seps: Sequence[str]) -> DataFrame:
    """``source_file, file_split, sep_no, width, word, n, first, mask`` of all lines, blank ones under ``BLANK``."""
    split = raw.select("source_file", "file_split", "mid", (F.trim("value") == "").alias("blank"),
                       *[split_fields(F.col("value"), s).alias(f"f{i}") for i, s in enumerate(seps)])

    def entries(i: int) -> Column:
        f = F.col(f"f{i}")
        words = F.sequence(F.lit(0), F.floor((F.size(f) - 1) / WORD).cast("int"))
        return F.transform(words, lambda w: F.struct(
            F.lit(i).alias("sep_no"), F.size(f).alias("width"), w.alias("word"), _filled(f, w).alias("mask")))

    blank = F.array(F.struct(F.lit(BLANK).alias("sep_no"), F.lit(0).alias("width"), F.lit(0).alias("word"),
                             F.lit(0).cast("long").alias("mask")))
    every = F.when(F.col("blank"), blank).otherwise(F.concat(*[entries(i) for i in range(len(seps))]))
    return (split.select("source_file", "file_split", "mid", F.inline(every))
            .groupBy("source_file", "file_split", "sep_no", "width", "word")
            .agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"), F.bit_or("mask").alias("mask")))


def _columns(mask: Column, word: Column) -> Column:
    """Column numbers (from 0) of the set bits of a word."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)),
                    lambda i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("long")) == 1)
    return F.transform(bits, lambda i: i + word * WORD)


def file_layout(state: DataFrame, kind: str, seps: Sequence[str]) -> DataFrame:
    """Per file with a row: ``sep, sep_no, kept, n_cols, w, first`` (sep NULL without an acceptable layout)."""
    rows = state.where(F.col("sep_no") != BLANK)
    heads = (rows.where("word = 0").groupBy("source_file", "sep_no")
             .agg(F.min(F.struct("file_split", "first", "width")).alias("head"))
             .select("source_file", "sep_no", F.col("head.width").alias("w"), F.col("head.first").alias("at")))
    masks = (rows.join(heads, ["source_file", "sep_no"]).where("width <= w")
             .groupBy("source_file", "sep_no", "w", "at", "word").agg(F.bit_or("mask").alias("mask")))
    kept = (masks.groupBy("source_file", "sep_no", "w", "at")
            .agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("words"))
            .withColumn("kept", F.flatten(F.transform("words", lambda e: _columns(e["mask"], e["word"])))))
    ok = F.size("kept") >= 2 if kind == "points" else F.size("kept").isin(2, 3)
    best = kept.groupBy("source_file").agg(
        F.min_by("at", "sep_no").alias("first"), F.min(F.when(ok, F.struct("sep_no", "w", "kept"))).alias("c"))
    names = F.array(*[F.lit(s) for s in seps])
    return best.select("source_file", "first", "c.sep_no", "c.w", "c.kept", F.size("c.kept").alias("n_cols"),
                       F.when(F.col("c").isNotNull(), F.element_at(names, F.col("c.sep_no") + 1)).alias("sep"))


def _splits(state: DataFrame, files: DataFrame) -> DataFrame:
    """Per split: place and number of its first line, place and number of its first row that stays.

    ``at0`` is the place that ``monotonically_increasing_id`` gives the first
    such row when the others are gone: rows of one task are counted on, so the
    splits before it in the same task count.
    """
    lines = (state.where("sep_no <= 0 and word = 0").groupBy("source_file", "file_split")
             .agg(F.min("first").alias("mid0"), F.sum("n").alias("lines")))
    chosen = files.select("source_file", "sep_no", "w", "header", F.col("first").alias("head_at"))
    stay = (state.join(chosen, ["source_file", "sep_no"]).where((F.col("word") == 0) & (F.col("width") <= F.col("w")))
            .groupBy("source_file", "file_split")
            .agg((F.sum("n") - F.max((F.col("header") & (F.col("first") == F.col("head_at"))).cast("int"))).alias("rows")))
    per = (lines.join(stay, ["source_file", "file_split"], "left").fillna(0, ["rows"])
           .withColumn("task", F.shiftright("mid0", 33)))
    before = Window.unboundedPreceding, -1
    by_file = Window.partitionBy("source_file").orderBy("file_split").rowsBetween(*before)
    by_task = Window.partitionBy("task").orderBy("mid0").rowsBetween(*before)

    def total(what: str, w) -> Column:
        return F.coalesce(F.sum(what).over(w), F.lit(0))
    return per.select("source_file", "file_split", "mid0", total("lines", by_file).alias("line0"),
                      (F.shiftleft("task", 33) + total("rows", by_task)).alias("at0"), total("rows", by_file).alias("row0"))


def _named_cells(kind: str, has_height: bool) -> dict[str, Column]:
    """Cells by name for the number of columns of the file."""
    if kind == "scope":
        three = F.col("n_cols") == 3
        return {"id": F.when(three, _cell(0)), "x": F.when(three, _cell(1)).otherwise(_cell(0)),
                "y": F.when(three, _cell(2)).otherwise(_cell(1))}
    names = ["x", "y", "h"] if has_height else ["x", "y"]
    with_id = F.col("n_cols") > len(names)
    return {"id": F.when(with_id, _cell(0)),
            **{n: F.when(with_id, _cell(j + 1)).otherwise(_cell(j)) for j, n in enumerate(names)}}


def read_text(spark: SparkSession, paths: Sequence[str], kind: str = "points", *, has_height: bool = True,
              sep: str = "auto", header: str | bool = "auto", swap_xy: bool = False, prefix: str = "P",
              on_bad: str = "fail") -> DataFrame | None:
    """Rows of text files as ``delimited.parse_points`` or ``parse_scope`` give them.

    None if the files have more splits than a broadcast table may hold rows.
    An empty file, or one of blank lines, is a bad file.
    """
    if on_bad not in ("fail", "drop", "quarantine", "keep"):
        raise ValueError("on_bad must be 'fail', 'drop', 'quarantine' or 'keep'")
    seps = SEPARATORS if sep == "auto" else [sep]
    raw = _raw(spark, paths)
    state = _stored(layout_state(raw, seps))
    if state.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        return None
    files = _stored(file_layout(state, kind, seps))
    if on_bad == "fail":
        seen = {_bare_path(r[0]) for r in files.select("source_file").collect()}  # a row per input file
        given = {_bare_path(p): p for p in raw.inputFiles()}
        empty = sorted(given[p] for p in given.keys() - seen)
        if empty:
            raise _named(empty[:20], "no rows in")
        odd = [r[0] for r in files.where("sep is null").select("source_file").limit(20).collect()]
        if odd:
            raise _named(odd, "no separator gives " + ("two or more" if kind == "points" else "two or three")
                         + " columns in")
    files = files.where("sep is not null")

    def fitting(per_file: DataFrame) -> DataFrame:
        rows = raw.where(F.trim("value") != "").join(F.broadcast(per_file), "source_file")
        rows = rows.withColumn("f", _split_any(seps, F.col("value"))).where(F.size("f") <= F.col("w"))
        return rows.withColumn("cells", F.transform("kept", lambda i: F.try_element_at(F.col("f"), i + 1)))

    named = _named_cells(kind, has_height)
    numbers = [n for n in named if n != "id"]
    tail = [F.try_element_at("cells", F.lit(-1))] + ([F.try_element_at("cells", F.lit(-2))] if kind == "scope" else [])

    def any_of(cells: Sequence[Column]) -> Column:
        found = F.lit(False)
        for c in cells:
            found = found | parse_number(c).isNull()
        return found

    given_header = F.lit(None).cast("boolean") if header == "auto" else F.lit(bool(header))
    if header != "auto" and on_bad in ("keep", "quarantine"):
        files = files.withColumn("header", given_header).withColumn("n_bad", F.lit(0))
    else:
        at_first = F.col("mid") == F.col("first")
        status = fitting(files).select("source_file", at_first.alias("one"), any_of(tail).alias("head"),
                                       any_of([named[n] for n in numbers]).alias("bad"))
        status = status.groupBy("source_file").agg(
            F.coalesce(given_header, F.bool_or(F.col("one") & F.col("head"))).alias("header"),
            F.count_if(F.col("bad") & ~F.col("one")).alias("below"),
            F.count_if(F.col("bad") & F.col("one")).alias("top"))
        status = status.select("source_file", "header", F.when(F.col("header"), F.col("below"))
                               .otherwise(F.col("below") + F.col("top")).alias("n_bad"))
        files = _stored(files.join(status, "source_file"))
    if on_bad == "fail":
        bad = [r[0] for r in files.where("n_bad > 0").select("source_file").limit(20).collect()]
        if bad:
            raise _named(bad, "non-numeric values in coordinate columns of")
    if on_bad == "drop":
        # rows of dropped files leave only after they are numbered, as their places count
        files = files.withColumn("out", F.col("n_bad") > 0)
    else:
        files = files.withColumn("out", F.lit(False))
    splits = _stored(_splits(state, files))
    rows = (fitting(files).where(~(F.col("header") & (F.col("mid") == F.col("first"))))
            .withColumn("at", F.monotonically_increasing_id()).where(~F.col("out"))
            .join(F.broadcast(splits), ["source_file", "file_split"]))
    rows = rows.withColumn("row_no", F.col("at") - F.col("at0") + F.col("row0") + 1)
    seq = (F.col("mid") - F.col("mid0") + F.col("line0") + 1).alias("seq")
    if kind == "points":
        auto = F.concat(F.lit(f"{prefix}_"), F.col("row_no").cast("string"))
        named["id"] = F.when(F.col("n_cols") > len(numbers), named["id"]).otherwise(auto)
    out = rows.select("source_file", F.col("row_no") if kind == "points" else seq,
                      *[c.alias(n) for n, c in named.items()])
    if swap_xy:
        out = swap_axes(out)
    out = out.withColumns({n: parse_number(n) for n in numbers})
    return out.dropna(subset=numbers) if on_bad == "quarantine" else out
