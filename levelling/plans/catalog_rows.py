"""Registered queries on awkward rows: several files, repeated and missing keys, wide files, large rings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import numbered_centres, polygon_vertices
from ..operators.lookup import cm_text, join_heights, parse_response
from ..operators.pairing import PairColumns, nearest_pair
from ..operators.polygons import points_in_ring
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from . import catalog as base
from . import pipelines as pl
from . import sqltext as q


# --- keys ------------------------------------------------------------------------------------

def compare_multi_file_q(spark: SparkSession, sf: str) -> DataFrame:
    """Two files whose row numbers collide, keyed by file and row number."""
    k = F.col("k")
    pts = fx.inp(spark, sf).withColumns({
        "source_file": F.concat(F.lit("file_"), (k % 2).cast("string")), "row_no": F.floor(k / 2)})
    return pl.compare(pts, key=["source_file", "row_no"], reference=fx.cmp(spark, sf),
                      max_distance=base.MAX_DISTANCE, decimals=base.DECIMALS, tolerance=base.TOLERANCE)


def _holes(p: DataFrame) -> DataFrame:
    """Points of which every 50th has no x and every 50th a NaN y."""
    k = F.col("k")
    return p.withColumns({"x": F.when(k % 50 != 0, F.col("x")),
                          "y": F.when(k % 50 == 1, F.lit(float("nan"))).otherwise(F.col("y"))})


def nearest_unlimited_holes_q(spark: SparkSession, sf: str) -> DataFrame:
    p = _holes(fx.inp(spark, sf)).select("k", "id", "x", "y")
    r = nearest_pair(p, fx.cmp(spark, sf), 0.0, names=PairColumns("cid", "cx", "cy", "d"))
    return r.select("id", "cid", "d")


def _nearest_unlimited_holes_sql() -> str:
    return f"""WITH {q.INP}, {q.CMP},
ok AS (SELECT * FROM inp WHERE k % 50 > 1),
cand AS (SELECT i.id, c.id AS cid, sqrt((i.x - c.x)*(i.x - c.x) + (i.y - c.y)*(i.y - c.y)) AS d
         FROM ok i CROSS JOIN cmp c),
best AS (SELECT id, arg_min(cid, (d, cid)) AS cid, min(d) AS d FROM cand GROUP BY id)
SELECT i.id, b.cid, b.d FROM inp i LEFT JOIN best b ON b.id = i.id"""


# --- heights ---------------------------------------------------------------------------------

def height_lookup_duplicates_q(spark: SparkSession, sf: str) -> DataFrame:
    """A height table that repeats every third key; the later row counts."""
    h = fx.heights_projected(spark, sf).withColumn("seq", F.lit(1))
    later = h.where(F.col("n_cm") % 3 == 0).select("n_cm", "e_cm", (F.col("h_ref") + F.lit(1.0)).alias("h_ref"),
                                                   F.lit(2).alias("seq"))
    p = base._inp_projected(spark, sf)
    return join_heights(p, later.unionByName(h), order="seq").select("k", "h_ref")


def _height_lookup_duplicates_sql() -> str:
    return (f"WITH {q.INP},\n" + base.INP_PROJ + ",\n" + q.HTS_PROJ +
            "\nSELECT p.k, CASE WHEN t.n_cm % 3 = 0 THEN t.h_ref + 1.0e0 ELSE t.h_ref END AS h_ref "
            "FROM ipk p LEFT JOIN hts t ON t.n_cm = p.n_cm AND t.e_cm = p.e_cm")


def parse_response_spaces_q(spark: SparkSession, sf: str) -> DataFrame:
    """Entries led by line feeds and tabs, heights with a type letter, infinite numbers."""
    p = base._inp_projected(spark, sf)
    k = F.col("k")
    h = (F.when(k % 70 == 0, F.lit("1d")).when(k % 70 == 1, F.lit("inf"))
         .otherwise((F.lit(100.0) + (k % 5000).cast("double") / 100.0).cast("string")))
    north = F.when(k % 90 == 0, F.lit("1e999")).otherwise(cm_text("n_cm"))
    entry = F.concat(F.lit("\n\t"), north, F.lit("\t"), cm_text("e_cm"), F.lit("  "), h, F.lit(" \n"))
    text = (p.select(F.floor(k / 300).alias("batch_no"), k, entry.alias("entry"))
            .groupBy("batch_no").agg(F.sort_array(F.collect_list(F.struct("k", "entry"))).alias("l"))
            .select("batch_no", F.concat_ws(",", F.col("l.entry")).alias("response")))
    return parse_response(text, keep=["batch_no"]).select("batch_no", "n_cm", "e_cm", "h_ref")


def _parse_response_spaces_sql() -> str:
    return (f"WITH {q.INP},\n" + base.INP_PROJ + """
SELECT CAST(floor(k/300) AS BIGINT) AS batch_no, CASE WHEN k % 90 <> 0 THEN n_cm END AS n_cm, e_cm,
       CASE WHEN k % 70 < 2 THEN 0.0e0 ELSE 100.0e0 + (k % 5000)/100.0e0 END AS h_ref
FROM ipk""")


# --- text ------------------------------------------------------------------------------------

def csv_text_q(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers as the CSV sink writes them: small and large ones without an exponent."""
    from ..sinks.writers import csv_text
    k = F.col("o_orderkey")
    m = (k * k * 7919) % 200001 - 100000
    o = fx.table(spark, sf, "orders").select(
        k.alias("k"), (m.cast("double") / F.lit(100000.0)).alias("small"),
        (m.cast("double") * F.lit(1000.0) + F.lit(0.5)).alias("large"))
    return csv_text(o).select("k", "small", "large")


def _csv_text_sql() -> str:
    return """WITH m AS (SELECT o_orderkey AS k, (o_orderkey*o_orderkey*7919) % 200001 - 100000 AS m FROM orders),
p AS (SELECT k, m, rtrim(lpad(CAST(abs(m) % 100000 AS VARCHAR), 5, '0'), '0') AS frac,
             2000*m + 1 AS twice FROM m)
SELECT k, concat(CASE WHEN m < 0 THEN '-' ELSE '' END, CAST(abs(m) // 100000 AS VARCHAR), '.',
                 CASE WHEN frac = '' THEN '0' ELSE frac END) AS small,
       concat(CASE WHEN twice < 0 THEN '-' ELSE '' END, CAST(abs(twice) // 2 AS VARCHAR), '.5') AS large
FROM p"""


WIDE = 70


def scan_wide_files_q(spark: SparkSession, sf: str) -> DataFrame:
    """Files written from ``orders`` and read back: one layout with 70 columns, one with 4.

    The columns beyond the fourth are empty but for the last; it is a number,
    so the first row is no header.
    """
    from ..sources.delimited import read_points
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    mx, my, mh = fx._scattered(k, 7919, 104729), fx._scattered(k, 15485, 611953), (k * 31) % 5000
    row = [F.concat(F.lit("P_"), k.cast("string")), base._txt(5900000, mx), base._txt(7400000, my),
           base._txt(100, mh)]
    wide = F.concat_ws(";", *row, *[F.lit("")] * (WIDE - 5), k.cast("string"))
    lines = o.select(F.when(k % 2 == 0, F.lit("wide")).otherwise(F.lit("plain")).alias("layout"),
                     F.when(k % 2 == 0, wide).otherwise(F.concat_ws(",", *row)).alias("value"))
    folder = f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    lines.write.partitionBy("layout").text(folder)
    return read_points(spark, [f"{folder}/layout=wide", f"{folder}/layout=plain"]).select("id", "x", "y", "h")


def _scan_wide_files_sql() -> str:
    mx, my, mh = ("(k*k*7919 + k*104729) % 199999", "(k*k*15485 + k*611953) % 199999", "(k*31) % 5000")
    num = [f"TRY_CAST({base._txt_sql(b, m)} AS DOUBLE)" for b, m in ((5900000, mx), (7400000, my), (100, mh))]
    return f"""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT concat('P_', CAST(k AS VARCHAR)) AS id, {num[0]} AS x, {num[1]} AS y, {num[2]} AS h FROM o"""


def scan_quarantine_q(spark: SparkSession, sf: str) -> DataFrame:
    """Good rows (reason null) and rejected lines of a file with bad heights, blank lines and long lines."""
    from ..sources.delimited import parse_points
    from ..sources.rejects import reject_lines
    k = F.col("o_orderkey")
    row = [k.cast("string"), base._txt(5900000, (k * k * 7919 + k * 104729) % 199999), F.lit("7400000"),
           F.when(k % 8 == 4, F.lit("1d")).when(k % 8 == 5, F.lit("")).otherwise(base._txt(100, (k * 31) % 5000))]
    text = F.concat_ws(";", *row, F.when(k % 8 == 7, F.lit("more")))
    lines = fx.table(spark, sf, "orders").select(
        F.lit("pts_q.csv").alias("source_file"), (k + 1).alias("line_no"), F.when(k % 8 == 6, F.lit("  ")).otherwise(text).alias("value"))
    lines = lines.unionByName(lines.where("line_no % 8 = 1").withColumns(
        {"source_file": F.lit("pts_r.csv"), "value": F.lit("one")}))
    good = parse_points(lines, on_bad="quarantine").select(
        "source_file", "id", F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("column"),
        F.lit(None).cast("string").alias("reason"))
    return good.unionByName(reject_lines(lines).select("source_file", F.lit(None).cast("string").alias("id"), "line_no",
                                                       "column", "reason"))


def _scan_quarantine_sql() -> str:
    return """SELECT 'pts_q.csv' AS source_file, CASE WHEN k % 8 < 4 THEN CAST(k AS VARCHAR) END AS id,
       CASE WHEN k % 8 >= 4 THEN k + 1 END AS line_no, CASE WHEN k % 8 IN (4, 5) THEN 'h' END AS "column",
       CASE k % 8 WHEN 4 THEN 'not a number' WHEN 5 THEN 'missing value' WHEN 6 THEN 'blank' WHEN 7 THEN 'too many cells' END AS reason
FROM (SELECT o_orderkey AS k FROM orders)
UNION ALL SELECT 'pts_r.csv', NULL, o_orderkey + 1, NULL, 'no layout' FROM orders WHERE o_orderkey % 8 = 0"""


# --- rings taken from rows ----------------------------------------------------------------------

def _ring_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A ring with one vertex per order: the upper chain by rising key, then the lower by falling key."""
    k = F.col("o_orderkey")
    up = k % 2 == 0
    return fx.table(spark, sf, "orders").select(
        F.when(up, k).otherwise(F.lit(1 << 40) - k).alias("seq"),
        (F.lit(5900000.0) + fx._hundredths(k)).alias("x"),
        F.when(up, F.lit(7400100.0) + fx._hundredths((k * 31) % 9000))
        .otherwise(F.lit(7400000.0) + fx._hundredths((k * 17) % 9000)).alias("y"))


def points_in_large_ring_q(spark: SparkSession, sf: str) -> DataFrame:
    top = fx.table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0]  # one number
    k = F.col("o_orderkey")
    pts = fx.table(spark, sf, "orders").select(
        k.alias("k"), (F.lit(5900000.0) + fx._hundredths((k * 7919) % F.lit(top)) + F.lit(0.005)).alias("x"),
        (F.lit(7400000.0) + fx._hundredths((k * 104729) % 20000) + F.lit(0.003)).alias("y"))
    return points_in_ring(pts, _ring_rows(spark, sf)).select("k", "inside")


def _edges_sql(ring: str) -> str:
    """Edges (x0, y0, x1, y1) of a ring table ``seq, x, y``, the closing one included."""
    return f"""rn AS (SELECT x, y, row_number() OVER (ORDER BY seq) AS i, count(*) OVER () AS n FROM {ring}),
edges AS (SELECT a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM rn a JOIN rn b ON b.i = a.i % a.n + 1)"""


def _inside_sql(points: str, cols: str) -> str:
    """Points with the parity of the edges crossed to their right."""
    return f"""SELECT {cols}, count(e.x0) % 2 = 1 AS inside
FROM {points} p LEFT JOIN edges e
  ON (e.y0 >= p.y) <> (e.y1 >= p.y)
 AND (((e.y1 - p.y)*(e.x0 - e.x1)) >= ((e.x1 - p.x)*(e.y0 - e.y1))) = (e.y1 >= p.y)
GROUP BY {cols}"""


def _points_in_large_ring_sql() -> str:
    return f"""WITH o AS (SELECT o_orderkey AS k FROM orders),
ring AS (
  SELECT CASE WHEN k % 2 = 0 THEN k ELSE 1099511627776 - k END AS seq, 5900000 + k/100.0e0 AS x,
         CASE WHEN k % 2 = 0 THEN 7400100 + ((k*31) % 9000)/100.0e0
              ELSE 7400000 + ((k*17) % 9000)/100.0e0 END AS y FROM o),
{_edges_sql('ring')},
pts AS (SELECT k, (5900000 + ((k*7919) % (SELECT max(k) FROM o))/100.0e0) + 0.005e0 AS x,
               (7400000 + ((k*104729) % 20000)/100.0e0) + 0.003e0 AS y FROM o),
r AS ({_inside_sql('pts', 'p.k')})
SELECT k, inside FROM r"""


def _octants(spark: SparkSession, sf: str) -> DataFrame:
    """A scope ring from the data: in each of eight directions the point farthest from the middle."""
    k = F.col("o_orderkey")
    dx = (k * k * 7919 + k * 104729) % 199999 - 100000
    dy = (k * k * 15485 + k * 611953) % 199999 - 100000
    t = fx.table(spark, sf, "orders").select(k.alias("k"), dx.alias("dx"), dy.alias("dy"))
    a, b = F.abs("dx"), F.abs("dy")
    octant = (F.when((F.col("dy") >= 0) & (F.col("dx") >= 0), F.when(a >= b, 0).otherwise(1))
              .when(F.col("dy") >= 0, F.when(a < b, 2).otherwise(3))
              .when(F.col("dx") < 0, F.when(a >= b, 4).otherwise(5))
              .otherwise(F.when(a < b, 6).otherwise(7)))
    far = t.groupBy(octant.alias("seq")).agg(F.max_by(
        F.struct("dx", "dy"), F.struct(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), -F.col("k"))).alias("v"))
    return far.select("seq", (F.lit(5901000.0) + fx._hundredths(F.col("v.dx"))).alias("x"),
                      (F.lit(7401000.0) + fx._hundredths(F.col("v.dy"))).alias("y"))


def _octant_grid_sql() -> str:
    grid = base._grid_sql(base.SPACING_SQL, tuple(
        f"(SELECT {fn}({c}) FROM ring)" for fn, c in (("min", "x"), ("min", "y"), ("max", "x"), ("max", "y"))),
        "SELECT r, c, x, y FROM (" + _inside_sql("grid", "p.r, p.c, p.x, p.y") + ") WHERE inside")
    return f"""t AS (SELECT o_orderkey AS k, (o_orderkey*o_orderkey*7919 + o_orderkey*104729) % 199999 - 100000 AS dx,
             (o_orderkey*o_orderkey*15485 + o_orderkey*611953) % 199999 - 100000 AS dy FROM orders),
d AS (SELECT *, CASE WHEN dy >= 0 AND dx >= 0 THEN CASE WHEN abs(dx) >= abs(dy) THEN 0 ELSE 1 END
                     WHEN dy >= 0 THEN CASE WHEN abs(dx) < abs(dy) THEN 2 ELSE 3 END
                     WHEN dx < 0 THEN CASE WHEN abs(dx) >= abs(dy) THEN 4 ELSE 5 END
                     ELSE CASE WHEN abs(dx) < abs(dy) THEN 6 ELSE 7 END END AS seq FROM t),
v AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY dx*dx + dy*dy DESC, k) AS place FROM d),
ring AS (SELECT seq, 5901000 + dx/100.0e0 AS x, 7401000 + dy/100.0e0 AS y FROM v WHERE place = 1),
{_edges_sql('ring')},
{grid}"""


def hex_grid_rows_q(spark: SparkSession, sf: str) -> DataFrame:
    ring = polygon_vertices(_octants(spark, sf))
    return numbered_centres(spark, ring, base.data_spacing(spark, sf)).select("id", "x", "y")


def grid_heights_rows_q(spark: SparkSession, sf: str) -> DataFrame:
    """Mode 5 with a ring and a height table that both come from the data.

    The table has the terrain height of the centre numbered as an order's key;
    every ninth order has none.
    """
    ring = polygon_vertices(_octants(spark, sf))
    spacing = base.data_spacing(spark, sf)
    k = F.col("o_orderkey")
    known = fx.table(spark, sf, "orders").where(k % 9 != 0).select(
        k.alias("seq_no"), (F.lit(100.0) + fx._hundredths((k * 31) % 5000)).alias("h_ref"))
    centres = pl.project_points(numbered_centres(spark, ring, spacing), "seq_no", "x", "y")
    table = centres.join(known, "seq_no").select("n_cm", "e_cm", "h_ref")
    return pl.grid_heights(spark, ring, spacing, heights=table).select("id", "x", "y", "h")


def _grid_heights_rows_sql() -> str:
    src = "(SELECT id, x, y, seq_no AS k FROM centres)"
    proj = (base.FIRST_ROW.replace("FROM inp i CROSS", f"FROM {src} i CROSS").replace("FROM inp)", f"FROM {src})")
            + ",\nrz AS (SELECT *, " + q.zone_sql("ge") + " AS zone FROM roles),\n"
            + q.projection_ctes("rz", "gn", "ge", "zone", name="ip")
            + f",\nipk AS (SELECT *, {q.cm_sql('n_1992')} AS n_cm, {q.cm_sql('e_1992')} AS e_cm FROM ip)")
    h = q.rint_sql("100 + ((o.o_orderkey*31) % 5000)/100.0e0", 1)
    return ("WITH " + _octant_grid_sql() + ",\n" + proj + f"""
SELECT i.id, {q.rint_sql('i.x', 2)} AS x, {q.rint_sql('i.y', 2)} AS y,
       CASE WHEN i.n_cm IS NOT NULL AND o.o_orderkey % 9 <> 0 THEN {h} END AS h
FROM ipk i LEFT JOIN orders o ON o.o_orderkey = i.k""")


def queries():
    return {
        "compare_multi_file": compare_multi_file_q,
        "nearest_unlimited_holes": nearest_unlimited_holes_q,
        "height_lookup_duplicates": height_lookup_duplicates_q,
        "parse_response_spaces": parse_response_spaces_q,
        "csv_text": csv_text_q,
        "scan_wide_files": scan_wide_files_q,
        "scan_quarantine": scan_quarantine_q,
        "points_in_large_ring": points_in_large_ring_q,
        "hex_grid_rows": hex_grid_rows_q,
        "grid_heights_rows": grid_heights_rows_q,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "compare_multi_file": base._compare_file_sql(),
        "nearest_unlimited_holes": _nearest_unlimited_holes_sql(),
        "height_lookup_duplicates": _height_lookup_duplicates_sql(),
        "parse_response_spaces": _parse_response_spaces_sql(),
        "csv_text": _csv_text_sql(),
        "scan_wide_files": _scan_wide_files_sql(),
        "scan_quarantine": _scan_quarantine_sql(),
        "points_in_large_ring": _points_in_large_ring_sql(),
        "hex_grid_rows": "WITH " + _octant_grid_sql() + "\nSELECT id, x, y FROM centres",
        "grid_heights_rows": _grid_heights_rows_sql(),
    }
