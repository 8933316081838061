"""Excel workbooks (.xlsx) as point or scope sources.

Workbooks are read with ``binaryFile`` and decoded inside tasks by
``mapInPandas``: an .xlsx file is a zip of XML parts, so the Python standard
library suffices.  Only the first sheet is read, every cell as text, rows are
padded to the widest row (a sheet is a rectangle) and emitted as lines in the
``source_file, line_no, value`` shape of ``delimited.read_lines`` with the
unit separator between cells.  Parsing then continues with the delimited
pipeline (column dropping, header test, arity, ids, validation).

A workbook is an indivisible file; each one is decoded by one task, and
different files run in parallel.  Legacy binary ``.xls`` is not supported.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .delimited import UNIT_SEP as CELL_SEP
from .delimited import parse_points, parse_scope

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
_REF = re.compile(r"([A-Z]+)(\d+)")


def _col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet_path(z: zipfile.ZipFile) -> str:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    sheet = wb.find("m:sheets/m:sheet", _NS)
    rid = sheet.get(f"{{{_NS['r']}}}id")
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    for rel in rels.findall("p:Relationship", _NS):
        if rel.get("Id") == rid:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else "xl/" + target
    raise ValueError("workbook has no first sheet")


def _text(el) -> str:
    return "".join(t.text or "" for t in el.iter(f"{{{_NS['m']}}}t"))


def sheet_rows(content: bytes) -> list[list[str | None]]:
    """Cells of the first sheet as text, rows padded to the widest row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            sst = ET.fromstring(z.read("xl/sharedStrings.xml"))
            shared = [_text(si) for si in sst.findall("m:si", _NS)]
        sheet = ET.fromstring(z.read(_first_sheet_path(z)))
    rows: dict[int, dict[int, str | None]] = {}
    for row in sheet.iter(f"{{{_NS['m']}}}row"):
        for c in row.findall("m:c", _NS):
            m = _REF.match(c.get("r", ""))
            if not m:
                continue
            ci, ri = _col_index(m.group(1)), int(m.group(2))
            t = c.get("t")
            v = c.find("m:v", _NS)
            if t == "s" and v is not None:
                val = shared[int(v.text)]
            elif t == "inlineStr":
                val = _text(c)
            elif v is not None:
                val = v.text
                if t not in ("str", "b", "e") and val is not None and re.fullmatch(r"-?\d+\.0", val):
                    val = val[:-2]
            else:
                val = None
            rows.setdefault(ri, {})[ci] = val
    if not rows:
        return []
    width = max(max(r) for r in rows.values()) + 1
    first = min(rows)
    return [[rows.get(i, {}).get(j) for j in range(width)] for i in range(first, max(rows) + 1)]


def _decode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for path, content in zip(pdf["path"], pdf["content"]):
            cells = sheet_rows(bytes(content))
            yield pd.DataFrame({
                "source_file": [path] * len(cells),
                "line_no": list(range(1, len(cells) + 1)),
                "value": [CELL_SEP.join("" if v is None else v.replace(CELL_SEP, " ") for v in row)
                          for row in cells],
            })


def read_workbook_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    from ..session import ship_package
    ship_package(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    # stored once: the sniffing and parsing jobs would each decode the workbooks again
    return files.mapInPandas(_decode, "source_file string, line_no long, value string").checkpoint()


def read_workbook_points(spark: SparkSession, paths, **kw) -> DataFrame:
    return parse_points(read_workbook_lines(spark, paths), sep=CELL_SEP, **kw)


def read_workbook_scope(spark: SparkSession, paths, **kw) -> DataFrame:
    return parse_scope(read_workbook_lines(spark, paths), sep=CELL_SEP, **kw)
