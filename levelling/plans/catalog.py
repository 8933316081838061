"""Registered queries: one per operator of SURVEY section 2, each with a DuckDB oracle.

Every query reads the driver's tables (through the derived fixtures) so its
work grows with the scale factor.  Column names match between a query and
its oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pairing import PairColumns, nearest_pair
from ..plans import pipelines as pl
from ..plans import sqltext as q
from ..sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

MAX_DISTANCE = 15.0
DECIMALS = 2
TOLERANCE = 0.2


# --- joins ---------------------------------------------------------------------------

def nearest_pair_q(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.inp(spark, sf)
    c = fx.cmp(spark, sf)
    r = nearest_pair(p.select("k", "id", "x", "y"), c, MAX_DISTANCE,
                     names=PairColumns("cid", "cx", "cy", "d"))
    return r.select("id", "cid", F.col("d").alias("d"))


NEAREST_SQL = f"""WITH {q.INP}, {q.CMP},
cand AS (
  SELECT i.k, c.id AS cid, c.x AS cx, c.y AS cy, c.h AS ch,
         sqrt((i.x - c.x)*(i.x - c.x) + (i.y - c.y)*(i.y - c.y)) AS d
  FROM inp i JOIN cmp c
    ON c.x BETWEEN i.x - {{r}} AND i.x + {{r}} AND c.y BETWEEN i.y - {{r}} AND i.y + {{r}}),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, cid) AS rn
                 FROM cand WHERE d <= {{r}}) WHERE rn = 1),
paired AS (
  SELECT i.id, i.x, i.y, i.h, i.k, b.cid, b.cx, b.cy, b.ch, b.d
  FROM inp i LEFT JOIN best b ON b.k = i.k)"""


def _nearest_sql(r: float) -> str:
    return NEAREST_SQL.replace("{r}", q.f(r))


# --- pipelines -----------------------------------------------------------------------

def compare_file_q(spark: SparkSession, sf: str) -> DataFrame:
    return pl.compare(fx.inp(spark, sf), key="k", reference=fx.cmp(spark, sf),
                      max_distance=MAX_DISTANCE, decimals=DECIMALS, tolerance=TOLERANCE)


def _compare_file_sql() -> str:
    diff = q.diff_sql("h", "ch", DECIMALS)
    return _nearest_sql(MAX_DISTANCE) + f"""
SELECT id AS id_odniesienia, {q.rint_sql('x', 2)} AS x_odniesienia, {q.rint_sql('y', 2)} AS y_odniesienia,
       {q.rint_sql('h', DECIMALS)} AS h_odniesienia, cid AS id_porownania,
       {q.rint_sql('cx', 2)} AS x_porownania, {q.rint_sql('cy', 2)} AS y_porownania,
       {q.rint_sql('ch', DECIMALS)} AS h_porownania, {q.rint_sql(diff, DECIMALS)} AS diff_h,
       {q.py_round_sql('d', 3)} AS odleglosc_pary, {q.flag_sql(diff, TOLERANCE)} AS osiaga_dokladnosc
FROM paired"""


# --- scalar layer: axes, zones, projection, keys ----------------------------------------

def _inp_projected(spark: SparkSession, sf: str) -> DataFrame:
    return pl.project_points(fx.inp(spark, sf), "k", "x", "y")


def axis_roles_q(spark, sf):
    from ..operators.axes import assign_roles
    return assign_roles(fx.inp(spark, sf), "k").select("k", "geodetic_northing", "geodetic_easting")


FIRST_ROW = """fr AS (SELECT arg_min(x, k) AS fx, arg_min(y, k) AS fy FROM inp),
roles AS (
  SELECT i.*,
         CASE WHEN {ey} THEN i.x WHEN {ex} THEN i.y ELSE i.x END AS gn,
         CASE WHEN {ey} THEN i.y WHEN {ex} THEN i.x ELSE i.y END AS ge
  FROM inp i CROSS JOIN fr)""".format(
    ey="coalesce(TRY_CAST(trunc(fy) AS BIGINT) BETWEEN 5000000 AND 8999999, false)",
    ex="coalesce(TRY_CAST(trunc(fx) AS BIGINT) BETWEEN 5000000 AND 8999999, false)")

INP_PROJ = (FIRST_ROW + ",\nrz AS (SELECT *, " + q.zone_sql("ge") + " AS zone FROM roles),\n"
            + q.projection_ctes("rz", "gn", "ge", "zone", name="ip")
            + f""",
ipk AS (SELECT *, {q.cm_sql('n_1992')} AS n_cm, {q.cm_sql('e_1992')} AS e_cm FROM ip)""")


def zone_epsg_q(spark, sf):
    from ..functions.numeric import source_epsg, zone_of
    z = fx.zoned(spark, sf)
    return z.select("k", zone_of("e").alias("zone"), source_epsg("e").alias("epsg"),
                    source_epsg("n").alias("epsg_of_northing"))


def project_2180_q(spark, sf):
    from ..functions.projection import project_2000_to_1992
    from ..functions.rounding import rint_n
    z = project_2000_to_1992(fx.zoned(spark, sf), "n", "e", "zone")
    return z.select("k", rint_n("e_1992", 2).alias("e_1992"), rint_n("n_1992", 2).alias("n_1992"))


def height_key_q(spark, sf):
    return _inp_projected(spark, sf).select("k", "n_cm", "e_cm")


def swap_axes_q(spark, sf):
    from ..sources.delimited import swap_axes
    return swap_axes(fx.inp(spark, sf)).select("k", "x", "y")


# --- height lookup ---------------------------------------------------------------------

def height_lookup_q(spark, sf):
    from ..operators.lookup import join_heights
    return join_heights(_inp_projected(spark, sf), fx.heights_projected(spark, sf)).select("k", "h_ref")


def missing_heights_q(spark, sf):
    from ..operators.lookup import missing_heights
    m = missing_heights(_inp_projected(spark, sf), fx.heights_projected(spark, sf))
    return m.select(F.col("id").alias("id_odniesienia"), F.col("x").alias("x_odniesienia"),
                    F.col("y").alias("y_odniesienia"))


def compare_heights_q(spark, sf):
    return pl.compare(fx.inp(spark, sf), key="k", heights=fx.heights_projected(spark, sf),
                      decimals=DECIMALS, height_tolerance=TOLERANCE)


def compare_both_q(spark, sf):
    return pl.compare(fx.inp(spark, sf), key="k", reference=fx.cmp(spark, sf),
                      heights=fx.heights_projected(spark, sf), max_distance=MAX_DISTANCE,
                      decimals=DECIMALS, tolerance=TOLERANCE, height_tolerance=TOLERANCE)


def enrich_xy_q(spark, sf):
    pts = fx.inp(spark, sf).select("id", "x", "y", "k")
    return pl.enrich_heights(pts, order="k", heights=fx.heights_projected(spark, sf))


def _service_cols(with_pair: bool) -> str:
    d = q.diff_sql("h", "h_ref", DECIMALS)
    cols = [f"id AS id_odniesienia", f"{q.rint_sql('x', 2)} AS x_odniesienia",
            f"{q.rint_sql('y', 2)} AS y_odniesienia", f"{q.rint_sql('h', DECIMALS)} AS h_odniesienia",
            f"{q.rint_sql(d, DECIMALS)} AS diff_h_geoportal", f"{q.rint_sql('h_ref', 1)} AS geoportal_h"]
    if with_pair:
        dp = q.diff_sql("h", "ch", DECIMALS)
        cols += ["cid AS id_porownania", f"{q.rint_sql('cx', 2)} AS x_porownania",
                 f"{q.rint_sql('cy', 2)} AS y_porownania", f"{q.rint_sql('ch', DECIMALS)} AS h_porownania",
                 f"{q.rint_sql(dp, DECIMALS)} AS diff_h", f"{q.py_round_sql('d', 3)} AS odleglosc_pary"]
    cols.append(f"{q.flag_sql(d, TOLERANCE)} AS osiaga_dokladnosc")
    return ",\n       ".join(cols)


def _service_sql(with_pair: bool) -> str:
    head = _nearest_sql(MAX_DISTANCE) if with_pair else f"WITH {q.INP}"
    src = "paired" if with_pair else "inp"
    return (head + ",\n" + q.HTS_PROJ + ",\n" + INP_PROJ.replace("FROM inp i CROSS", f"FROM {src} i CROSS")
            + f""",
withh AS (SELECT p.*, t.h_ref FROM ipk p LEFT JOIN hts t ON t.n_cm = p.n_cm AND t.e_cm = p.e_cm)
SELECT {_service_cols(with_pair)}
FROM withh""")


# --- service path ----------------------------------------------------------------------

def terrain_height(n_cm: int, e_cm: int) -> float:
    """Synthetic terrain used by the service queries: a function of the position."""
    return 100.0 + ((n_cm * 7 + e_cm * 3) % 100000) / 1000.0


TERRAIN_SQL = "(100.0e0 + ((n_cm*7 + e_cm*3) % 100000)/1000.0e0)"


def terrain_service(points: list[tuple[float, float]]) -> str:
    """Stand-in for the height service: ``[(e, n), ...]`` -> ``"n e h,..."`` text."""
    out = []
    for e, n in points:
        n_cm, e_cm = round(n * 100), round(e * 100)
        out.append(f"{n:.2f} {e:.2f} {terrain_height(n_cm, e_cm)!r}")
    return ",".join(out)


def height_service_q(spark, sf):
    from ..operators.lookup import fetch_heights
    return fetch_heights(_inp_projected(spark, sf), terrain_service).select("n_cm", "e_cm", "h_ref")


def _responses(spark, sf) -> DataFrame:
    """Service answers built from the projected input, 300 entries per text,
    with short entries and unparsable heights mixed in."""
    from ..operators.lookup import cm_text
    p = _inp_projected(spark, sf)
    k = F.col("k")
    h = F.when(k % 70 == 0, F.lit("abc")).otherwise((F.lit(100.0) + (k % 5000).cast("double") / 100.0).cast("string"))
    entry = F.when(k % 50 == 0, F.concat(cm_text("n_cm"), F.lit(" "), cm_text("e_cm"))) \
        .otherwise(F.concat(cm_text("n_cm"), F.lit("  "), cm_text("e_cm"), F.lit(" "), h))
    return (p.select(F.floor(k / 300).alias("batch_no"), k, entry.alias("entry"))
            .groupBy("batch_no").agg(F.sort_array(F.collect_list(F.struct("k", "entry"))).alias("l"))
            .select("batch_no", F.concat_ws(", ", F.col("l.entry")).alias("response")))


def parse_response_q(spark, sf):
    from ..operators.lookup import parse_response
    return parse_response(_responses(spark, sf), keep=["batch_no"]).select("batch_no", "n_cm", "e_cm", "h_ref")


def _cm_text_sql(c: str) -> str:
    return (f"concat(CASE WHEN {c} < 0 THEN '-' ELSE '' END, CAST(floor(abs({c})/100) AS BIGINT), '.', "
            f"lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0'))")


def _parse_response_sql() -> str:
    h = ("CASE WHEN k % 70 = 0 THEN 'abc' ELSE CAST(100.0e0 + (k % 5000)/100.0e0 AS VARCHAR) END")
    return (f"WITH {q.INP},\n" + INP_PROJ + f""",
ent AS (SELECT floor(k/300) AS batch_no, k,
          CASE WHEN k % 50 = 0 THEN concat({_cm_text_sql('n_cm')}, ' ', {_cm_text_sql('e_cm')})
               ELSE concat({_cm_text_sql('n_cm')}, '  ', {_cm_text_sql('e_cm')}, ' ', {h}) END AS entry
        FROM ipk),
toks AS (SELECT batch_no, regexp_split_to_array(trim(entry), '\\s+') AS t FROM ent)
SELECT CAST(batch_no AS BIGINT) AS batch_no, {q.cm_sql('TRY_CAST(t[1] AS DOUBLE)')} AS n_cm,
       {q.cm_sql('TRY_CAST(t[2] AS DOUBLE)')} AS e_cm, coalesce(TRY_CAST(t[3] AS DOUBLE), 0.0e0) AS h_ref
FROM toks WHERE len(t) = 3""")


def batch_requests_q(spark, sf):
    from ..operators.lookup import request_batches
    return request_batches(_inp_projected(spark, sf))


def _batch_requests_sql() -> str:
    return (f"WITH {q.INP},\n" + INP_PROJ + f""",
d AS (SELECT DISTINCT n_cm, e_cm FROM ipk WHERE n_cm IS NOT NULL AND e_cm IS NOT NULL),
n AS (SELECT *, row_number() OVER (ORDER BY n_cm, e_cm) - 1 AS idx FROM d)
SELECT CAST(floor(idx/300) AS BIGINT) AS batch_no, count(*) AS n_points,
       string_agg(concat({_cm_text_sql('n_cm')}, ' ', {_cm_text_sql('e_cm')}), ',' ORDER BY idx) AS payload
FROM n GROUP BY 1""")


def last_batch_wins_q(spark, sf):
    from ..operators.lookup import last_answer_wins
    p = _inp_projected(spark, sf)
    k = F.col("k")
    a1 = p.select("n_cm", "e_cm", (F.col("h") + F.lit(1.0)).alias("h_ref"), F.lit(1).alias("pass_no"),
                  F.floor(k / 300).alias("batch_no"), (k % 300).cast("int").alias("pos"))
    a2 = p.where(k % 5 == 0).select("n_cm", "e_cm", (F.col("h") + F.lit(2.0)).alias("h_ref"),
                                    F.lit(2).alias("pass_no"), F.floor(k / 900).alias("batch_no"),
                                    (k % 900).cast("int").alias("pos"))
    return last_answer_wins(a1.unionByName(a2))


def _last_batch_wins_sql() -> str:
    return (f"WITH {q.INP},\n" + INP_PROJ + """,
a AS (SELECT n_cm, e_cm, h + 1.0e0 AS h_ref, 1 AS pass_no, floor(k/300) AS batch_no, k % 300 AS pos FROM ipk
      UNION ALL
      SELECT n_cm, e_cm, h + 2.0e0, 2, floor(k/900), k % 900 FROM ipk WHERE k % 5 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n_cm, e_cm ORDER BY pass_no DESC, batch_no DESC, pos DESC) AS rn FROM a)
SELECT n_cm, e_cm, h_ref FROM r WHERE rn = 1""")


# --- grids and thinning ------------------------------------------------------------------

GRID_POINTS_PER_ORDER = 1500.0


def data_spacing(spark: SparkSession, sf: str) -> float:
    """Grid spacing that keeps the number of centres proportional to the data."""
    import math
    n = fx.table(spark, sf, "orders").count()
    return fx.SCOPE_SPACING * math.sqrt(GRID_POINTS_PER_ORDER / max(n, 1))


SPACING_SQL = f"(SELECT {q.f(fx.SCOPE_SPACING)}*sqrt({q.f(GRID_POINTS_PER_ORDER)}/count(*)) FROM orders)"


def _grid_sql(spacing_sql: str, box: tuple[str, str, str, str] | None = None, inside: str | None = None) -> str:
    """CTEs of the grid: of the fixture polygon, or of a box and an ``inside`` select given as SQL."""
    xs = [p[0] for p in fx.SCOPE_POLYGON]
    ys = [p[1] for p in fx.SCOPE_POLYGON]
    x0, y0, x1, y1 = box or (q.f(min(xs)), q.f(min(ys)), q.f(max(xs)), q.f(max(ys)))
    inside = inside or f"SELECT * FROM grid WHERE {q.polygon_inside_sql('x', 'y')}"
    return f"""params AS (SELECT d, d*sqrt(3.0e0)/2.0e0 AS dy FROM (SELECT {spacing_sql} AS d)),
lat AS (
  SELECT 0 AS parity, {y0} AS ly0, ({y0} + dy*2.0e0) - {y0} AS lys,
         CAST(ceil((({y1} + dy) - {y0})/(dy*2.0e0)) AS BIGINT) AS ny,
         {x0} AS lx0, ({x0} + d) - {x0} AS lxs, CAST(ceil((({x1} + d) - {x0})/d) AS BIGINT) AS nx FROM params
  UNION ALL
  SELECT 1, {y0} + dy, (({y0} + dy) + dy*2.0e0) - ({y0} + dy),
         CAST(ceil((({y1} + dy) - ({y0} + dy))/(dy*2.0e0)) AS BIGINT),
         {x0} - d/2.0e0, (({x0} - d/2.0e0) + d) - ({x0} - d/2.0e0),
         CAST(ceil((({x1} + d) - ({x0} - d/2.0e0))/d) AS BIGINT) FROM params),
grows AS (SELECT *, unnest(generate_series(0, ny - 1)) AS m FROM lat),
gpts AS (SELECT *, unnest(generate_series(0, nx - 1)) AS c FROM grows),
grid AS (SELECT m*2 + parity AS r, c, lx0 + c*lxs AS x, ly0 + m*lys AS y FROM gpts),
inside AS ({inside}),
centres AS (SELECT concat('P_', CAST(row_number() OVER (ORDER BY r, c) AS VARCHAR)) AS id,
                   row_number() OVER (ORDER BY r, c) AS seq_no, r, c, x, y FROM inside)"""


def bbox_q(spark, sf):
    from ..operators.grid import bounding_box
    return bounding_box(fx.inp(spark, sf))


def points_in_polygon_q(spark, sf):
    from ..functions.geometry import inside_polygon
    return fx.inp(spark, sf).select("k", inside_polygon("x", "y", fx.SCOPE_POLYGON).alias("inside"))


def hex_grid_q(spark, sf):
    from ..operators.grid import numbered_centres
    return numbered_centres(spark, fx.SCOPE_POLYGON, data_spacing(spark, sf)).select("id", "x", "y")


def radius_join_q(spark, sf):
    from ..functions.rounding import rint_n
    from ..operators.grid import centre_of
    m = centre_of(fx.inp(spark, sf).select("k", "x", "y"), fx.SCOPE_POLYGON, fx.SCOPE_SPACING)
    return m.select("k", "r", "c", rint_n("centre_distance", 6).alias("centre_distance"))


def _candidate_sql(src: str, spacing: str) -> str:
    """Every (row, centre) pair within spacing/2 by brute force over the grid centres."""
    return f"""cand AS (
  SELECT s.*, g.r, g.c, g.x AS cx, g.y AS cy,
         sqrt((s.x - g.x)*(s.x - g.x) + (s.y - g.y)*(s.y - g.y)) AS cd
  FROM {src} s JOIN inside g
    ON g.x BETWEEN s.x - {spacing} AND s.x + {spacing} AND g.y BETWEEN s.y - {spacing} AND s.y + {spacing}
  WHERE sqrt((s.x - g.x)*(s.x - g.x) + (s.y - g.y)*(s.y - g.y)) <= {spacing}/2.0e0)"""


def _radius_join_sql() -> str:
    sp = q.f(fx.SCOPE_SPACING)
    return (f"WITH {q.INP},\n" + _grid_sql(sp) + ",\n" + _candidate_sql("inp", sp) +
            f"\nSELECT k, r, c, {q.rint_sql('cd', 6)} AS centre_distance FROM cand")


def hex_thin_q(spark, sf):
    from ..functions.geometry import inside_polygon
    from ..operators.grid import thin_to_grid
    p = fx.inp(spark, sf).where(inside_polygon("x", "y", fx.SCOPE_POLYGON))
    score = F.abs(((F.col("k") * 13) % 41 - 20).cast("double") / F.lit(100.0))
    return thin_to_grid(p, fx.SCOPE_POLYGON, fx.SCOPE_SPACING, key="k", score=score).select("k", "r", "c")


def _thin_sql(src: str, score: str, key: str, cols: str) -> str:
    """Greedy-free oracle: arg-min per centre; valid because discs do not overlap."""
    sp = q.f(fx.SCOPE_SPACING)
    return (_grid_sql(sp) + ",\n" + _candidate_sql(src, sp) + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY {score}, cd, {key}) AS rn FROM cand)
SELECT {cols} FROM ranked WHERE rn = 1""")


def _hex_thin_sql() -> str:
    return (f"WITH {q.INP},\npin AS (SELECT * FROM inp WHERE {q.polygon_inside_sql('x', 'y')}),\n"
            + _thin_sql("pin", "abs((((k*13) % 41) - 20)/100.0e0)", "k", "k, r, c"))


def thin_accurate_q(spark, sf):
    # Thinning picks per centre and orders by centre; the |diff| order of the
    # comparison result does not matter here, so it is not sorted first.
    res = pl.compare(fx.inp(spark, sf), key="k", heights=fx.heights_projected(spark, sf),
                     decimals=DECIMALS, height_tolerance=TOLERANCE, sort=False)
    return pl.thin_accurate(res, fx.SCOPE_POLYGON, fx.SCOPE_SPACING)


def _thin_accurate_sql() -> str:
    base = _service_sql(False)
    head, select = base.rsplit("SELECT ", 1)
    res_cols = ", ".join(["id_odniesienia", "x_odniesienia", "y_odniesienia", "h_odniesienia",
                          "diff_h_geoportal", "geoportal_h", "osiaga_dokladnosc"])
    return (head.rstrip() + f""",
res AS (SELECT {select}),
cands AS (SELECT *, x_odniesienia AS x, y_odniesienia AS y FROM res
          WHERE osiaga_dokladnosc = 'Tak' AND {q.polygon_inside_sql('x_odniesienia', 'y_odniesienia')}
            AND x_odniesienia IS NOT NULL AND y_odniesienia IS NOT NULL
            AND h_odniesienia IS NOT NULL AND geoportal_h IS NOT NULL),
""" + _thin_sql("cands", "abs(h_odniesienia - geoportal_h)", "id_odniesienia", res_cols))


def grid_heights_q(spark, sf):
    return pl.grid_heights(spark, fx.SCOPE_POLYGON, data_spacing(spark, sf), prefix="P",
                           fetch=terrain_service).select("id", "x", "y", "h")


def _grid_heights_sql() -> str:
    src = "(SELECT id, x, y, seq_no AS k FROM centres)"
    proj = (FIRST_ROW.replace("FROM inp i CROSS", f"FROM {src} i CROSS").replace("FROM inp)", f"FROM {src})")
            + ",\nrz AS (SELECT *, " + q.zone_sql("ge") + " AS zone FROM roles),\n"
            + q.projection_ctes("rz", "gn", "ge", "zone", name="ip")
            + f",\nipk AS (SELECT *, {q.cm_sql('n_1992')} AS n_cm, {q.cm_sql('e_1992')} AS e_cm FROM ip)")
    return ("WITH " + _grid_sql(SPACING_SQL) + ",\n" + proj +
            f"\nSELECT id, {q.rint_sql('x', 2)} AS x, {q.rint_sql('y', 2)} AS y, "
            f"{q.rint_sql(TERRAIN_SQL, 1)} AS h FROM ipk")


# --- more joins -------------------------------------------------------------------------------

def nearest_unlimited_q(spark, sf):
    p = fx.inp(spark, sf)
    c = fx.cmp(spark, sf)
    r = nearest_pair(p.select("k", "id", "x", "y"), c, 0.0,
                     names=PairColumns("cid", "cx", "cy", "d"))
    return r.select("id", "cid", "d")


def _nearest_unlimited_sql() -> str:
    return f"""WITH {q.INP}, {q.CMP},
cand AS (SELECT i.id, c.id AS cid, sqrt((i.x - c.x)*(i.x - c.x) + (i.y - c.y)*(i.y - c.y)) AS d
         FROM inp i CROSS JOIN cmp c)
SELECT id, arg_min(cid, (d, cid)) AS cid, min(d) AS d FROM cand GROUP BY id"""


def nearest_mutual_q(spark, sf):
    from ..operators.pairing import mutual_pairs
    p = fx.inp(spark, sf).select("id", "x", "y")
    c = fx.cmp(spark, sf).select(F.col("id").alias("cid"), "x", "y")
    return mutual_pairs(p, c, MAX_DISTANCE, left_key="id", right_key="cid").select(
        "id", F.col("cid_r").alias("cid"), "distance")


def _nearest_mutual_sql() -> str:
    r = q.f(MAX_DISTANCE)
    return f"""WITH {q.INP}, {q.CMP},
cand AS (
  SELECT i.id, c.id AS cid, sqrt((i.x - c.x)*(i.x - c.x) + (i.y - c.y)*(i.y - c.y)) AS d
  FROM inp i JOIN cmp c ON c.x BETWEEN i.x - {r} AND i.x + {r} AND c.y BETWEEN i.y - {r} AND i.y + {r}),
ok AS (SELECT * FROM cand WHERE d <= {r}),
fwd AS (SELECT id, arg_min(cid, (d, cid)) AS cid, min(d) AS d FROM ok GROUP BY id),
bwd AS (SELECT cid, arg_min(id, (d, id)) AS id FROM ok GROUP BY cid)
SELECT f.id, f.cid, f.d AS distance FROM fwd f JOIN bwd b ON b.cid = f.cid AND b.id = f.id"""


# --- rounding, differences, flag, order -----------------------------------------------------

def _pairs_by_key(spark, sf) -> DataFrame:
    p = fx.inp(spark, sf)
    c = fx.cmp(spark, sf).select("k", F.col("id").alias("cid"), F.col("x").alias("cx"),
                                 F.col("y").alias("cy"), F.col("h").alias("ch"))
    return p.join(c, "k")


PAIRS_SQL = "pairs AS (SELECT i.*, c.id AS cid, c.x AS cx, c.y AS cy, c.h AS ch FROM inp i JOIN cmp c ON c.k = i.k)"


def height_diff_q(spark, sf):
    from ..functions.rounding import rounded_difference
    return _pairs_by_key(spark, sf).select(
        "k", rounded_difference("h", "ch", 1).alias("diff_1"), rounded_difference("h", "ch", 2).alias("diff_2"),
        rounded_difference("x", "cx", 3).alias("dx_3"))


def _height_diff_sql() -> str:
    return (f"WITH {q.INP}, {q.CMP}, {PAIRS_SQL}\nSELECT k, {q.diff_sql('h', 'ch', 1)} AS diff_1, "
            f"{q.diff_sql('h', 'ch', 2)} AS diff_2, {q.diff_sql('x', 'cx', 3)} AS dx_3 FROM pairs")


def accuracy_flag_q(spark, sf):
    from ..functions.rounding import rounded_difference
    from ..operators.accuracy import accuracy_flag
    d = rounded_difference("h", "ch", DECIMALS)
    return _pairs_by_key(spark, sf).select("k", accuracy_flag(d, TOLERANCE).alias("osiaga_dokladnosc"),
                                           accuracy_flag(d, 0.0).alias("exact"))


def _accuracy_flag_sql() -> str:
    d = q.diff_sql("h", "ch", DECIMALS)
    return (f"WITH {q.INP}, {q.CMP}, {PAIRS_SQL}\nSELECT k, {q.flag_sql(d, TOLERANCE)} AS osiaga_dokladnosc, "
            f"{q.flag_sql(d, 0.0)} AS exact FROM pairs")


def result_rounding_q(spark, sf):
    from ..functions.rounding import py_round, rint_n
    c = fx.cmp(spark, sf)
    return c.select("k", rint_n("x", 2).alias("x2"), rint_n("h", 1).alias("h1"), rint_n("h", 0).alias("h0"),
                    py_round("h", 1).alias("h1_py"))


def _result_rounding_sql() -> str:
    return (f"WITH {q.INP}, {q.CMP}\nSELECT k, {q.rint_sql('x', 2)} AS x2, {q.rint_sql('h', 1)} AS h1, "
            f"{q.rint_sql('h', 0)} AS h0, {q.py_round_sql('h', 1)} AS h1_py FROM cmp")


def abs_sort_q(spark, sf):
    from ..operators.numbering import sequential_index
    r = compare_file_q(spark, sf).select("id_odniesienia", "diff_h")
    r = r.withColumns({"__nul": F.col("diff_h").isNull(), "__neg": -F.abs(F.col("diff_h"))})
    r = sequential_index(r, ["__nul", "__neg", "id_odniesienia"], out="position")
    return r.select("id_odniesienia", "diff_h", "position")


def _abs_sort_sql() -> str:
    base = _compare_file_sql()
    head, select = base.rsplit("SELECT ", 1)
    return (head.rstrip() + f""",
res AS (SELECT {select})
SELECT id_odniesienia, diff_h,
       row_number() OVER (ORDER BY abs(diff_h) DESC NULLS LAST, id_odniesienia) AS position FROM res""")


# --- zones, checks, metrics, sinks ------------------------------------------------------------

def zone_counts_q(spark, sf):
    from ..operators.axes import zone_counts
    return zone_counts(fx.zoned(spark, sf), easting="e")


def zone_check_q(spark, sf):
    from ..operators.axes import check_zones
    a, b = check_zones(fx.inp(spark, sf), "k", fx.scope_polygon(spark), "seq")
    n = fx.inp(spark, sf).agg(F.count(F.lit(1)).alias("n_points"))
    return n.select(F.lit(a).cast("int").alias("input_epsg"), F.lit(b).cast("int").alias("scope_epsg"),
                    F.lit(a is None or b is None or a == b).alias("zone_ok"), "n_points")


def _zone_check_sql() -> str:
    return (f"WITH {q.INP},\n{FIRST_ROW},\nfirst AS (SELECT * FROM roles ORDER BY k LIMIT 1)\n"
            f"SELECT 2171 + {q.zone_sql('ge')} AS input_epsg, 2178 AS scope_epsg, "
            f"coalesce(2171 + {q.zone_sql('ge')} = 2178, true) AS zone_ok, "
            "(SELECT count(*) FROM inp) AS n_points FROM first")


def run_metrics_q(spark, sf):
    from ..sinks.writers import run_metrics
    return run_metrics(compare_file_q(spark, sf))


def _run_metrics_sql() -> str:
    base = _compare_file_sql()
    head, select = base.rsplit("SELECT ", 1)
    return (head.rstrip() + f""",
res AS (SELECT {select})
SELECT count(*) AS n_rows, count(id_porownania) AS n_paired,
       count(*) FILTER (WHERE osiaga_dokladnosc = 'Tak') AS n_accurate,
       count(*) FILTER (WHERE osiaga_dokladnosc = 'Nie') AS n_inaccurate,
       count(*) FILTER (WHERE osiaga_dokladnosc IS NULL) AS n_unflagged FROM res""")


def split_accuracy_q(spark, sf):
    from ..sinks.writers import with_split_label
    return with_split_label(compare_file_q(spark, sf)).select("id_odniesienia", "diff_h", "dokladnosc")


def _split_accuracy_sql() -> str:
    base = _compare_file_sql()
    head, select = base.rsplit("SELECT ", 1)
    return (head.rstrip() + f""",
res AS (SELECT {select})
SELECT id_odniesienia, diff_h,
       CASE WHEN coalesce(lower(trim(osiaga_dokladnosc)) = 'tak', false) THEN 'dokladne' ELSE 'niedokladne' END
         AS dokladnosc FROM res""")


def geo_layer_q(spark, sf):
    from ..sinks.writers import spatial_layer, split_layer
    layer = split_layer(spatial_layer(compare_heights_q(spark, sf), fx.inp(spark, sf), order="k"))
    return layer.select("id_odniesienia", F.col("geometry.x").alias("geom_x"),
                        F.col("geometry.y").alias("geom_y"), "epsg", "epsg_layer", "eksport")


def _geo_layer_sql() -> str:
    base = _service_sql(False)
    head, select = base.rsplit("SELECT ", 1)
    return (head.rstrip() + f""",
res AS (SELECT {select}),
lay AS (SELECT 2171 + {q.zone_sql('ge')} AS epsg_layer FROM roles ORDER BY k LIMIT 1),
rz2 AS (SELECT r.*, 2171 + {q.zone_sql('CASE WHEN coalesce(TRY_CAST(trunc(fr.fy) AS BIGINT) BETWEEN 5000000 AND 8999999, false) THEN r.y_odniesienia WHEN coalesce(TRY_CAST(trunc(fr.fx) AS BIGINT) BETWEEN 5000000 AND 8999999, false) THEN r.x_odniesienia ELSE r.y_odniesienia END')} AS epsg
        FROM res r CROSS JOIN fr)
SELECT id_odniesienia, y_odniesienia AS geom_x, x_odniesienia AS geom_y, epsg, epsg_layer,
       coalesce(lower(trim(osiaga_dokladnosc)) = 'tak', false) AS eksport
FROM rz2 CROSS JOIN lay""")


# --- delimited text sources -------------------------------------------------------------------

POINT_FILES = ["pts_a.csv", "pts_b.txt", "pts_c.txt", "pts_d.csv"]


def _txt(base: int, m, sep: str = "."):
    return F.concat((F.lit(base) + F.floor(m / 100)).cast("string"), F.lit(sep),
                    F.lpad((m % 100).cast("string"), 2, "0"))


def _txt_sql(base: int, m: str, sep: str = ".") -> str:
    return f"concat(CAST({base} + ({m}) // 100 AS VARCHAR), '{sep}', lpad(CAST(({m}) % 100 AS VARCHAR), 2, '0'))"


def _point_lines(spark, sf) -> DataFrame:
    """Text lines of four point files written from ``orders`` in different layouts."""
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    mx = (k * k * 7919 + k * 104729) % 199999
    my = (k * k * 15485 + k * 611953) % 199999
    mh = (k * 31) % 5000
    k4 = F.floor(k / 4)
    pid = F.concat(F.lit("P_"), k.cast("string"))
    a = o.where(k % 4 == 0).select(F.lit(POINT_FILES[0]).alias("source_file"), (k4 + 2).alias("line_no"),
                                   F.concat_ws(";", pid, _txt(5900000, mx, ","), _txt(7400000, my, ","),
                                               _txt(100, mh, ",")).alias("value"))
    header = spark.createDataFrame([(POINT_FILES[0], 1, "nr;x;y;h")], "source_file string, line_no long, value string")
    b = o.where(k % 4 == 1).select(F.lit(POINT_FILES[1]), (k4 + 1),
                                   F.concat_ws(",", _txt(5900000, mx), _txt(7400000, my), _txt(100, mh)))
    c = o.where(k % 4 == 2).select(F.lit(POINT_FILES[2]), (k4 * 2 + 1),
                                   F.concat(F.lit("  "), pid, F.lit("   "), _txt(5900000, mx), F.lit(" "),
                                            _txt(7400000, my), F.lit("\t"), _txt(100, mh), F.lit(" 1")))
    blank = o.where((k % 4 == 2) & (k4 % 10 == 0)).select(F.lit(POINT_FILES[2]), (k4 * 2 + 2), F.lit(""))
    did = (F.when(k % 7 == 0, F.concat(F.lit('"Q;'), k.cast("string"), F.lit('"')))
           .when(k % 11 == 3, F.lit("NA")).otherwise(pid))
    dval = F.concat(F.concat_ws(";", did, _txt(5900000, mx), _txt(7400000, my), _txt(100, mh)), F.lit(";"),
                    F.when(k % 13 == 5, F.lit(";9")).otherwise(F.lit("")))
    d = o.where(k % 4 == 3).select(F.lit(POINT_FILES[3]), (k4 + 1), dval)
    out = header
    for part in (a, b, c, blank, d):
        out = out.unionByName(part.toDF("source_file", "line_no", "value"))
    return out


def scan_delimited_q(spark, sf):
    from ..sources.delimited import parse_points
    return parse_points(_point_lines(spark, sf))


def _scan_delimited_sql() -> str:
    mx = "(k*k*7919 + k*104729) % 199999"
    my = "(k*k*15485 + k*611953) % 199999"
    mh = "(k*31) % 5000"
    num = lambda base, m: f"TRY_CAST({_txt_sql(base, m)} AS DOUBLE)"
    return f"""WITH o AS (SELECT o_orderkey AS k FROM orders),
rows_ AS (
  SELECT '{POINT_FILES[0]}' AS source_file, k, concat('P_', CAST(k AS VARCHAR)) AS id FROM o WHERE k % 4 = 0
  UNION ALL SELECT '{POINT_FILES[1]}', k, NULL FROM o WHERE k % 4 = 1
  UNION ALL SELECT '{POINT_FILES[2]}', k, concat('P_', CAST(k AS VARCHAR)) FROM o WHERE k % 4 = 2
  UNION ALL SELECT '{POINT_FILES[3]}', k,
     CASE WHEN k % 7 = 0 THEN concat('Q;', CAST(k AS VARCHAR)) WHEN k % 11 = 3 THEN NULL
          ELSE concat('P_', CAST(k AS VARCHAR)) END
     FROM o WHERE k % 4 = 3 AND k % 13 <> 5),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY k) AS row_no FROM rows_)
SELECT source_file, row_no,
       CASE WHEN source_file = '{POINT_FILES[1]}' THEN concat('P_', CAST(row_no AS VARCHAR)) ELSE id END AS id,
       {num(5900000, mx)} AS x, {num(7400000, my)} AS y, {num(100, mh)} AS h
FROM numbered"""


SCOPE_FILES = ["scope_a.csv", "scope_b.txt"]


def _scope_lines(spark, sf) -> DataFrame:
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    mx = (k * k * 7919 + k * 104729) % 199999
    my = (k * k * 15485 + k * 611953) % 199999
    k2 = F.floor(k / 2)
    a = o.where(k % 2 == 0).select(F.lit(SCOPE_FILES[0]).alias("source_file"), (k2 + 2).alias("line_no"),
                                   F.concat_ws(";", F.concat(F.lit("W"), k.cast("string")),
                                               _txt(5900000, mx, ","), _txt(7400000, my, ",")).alias("value"))
    header = spark.createDataFrame([(SCOPE_FILES[0], 1, "nr;x;y")], "source_file string, line_no long, value string")
    b = o.where(k % 2 == 1).select(F.lit(SCOPE_FILES[1]), (k2 + 1),
                                   F.concat(_txt(5900000, mx), F.lit(" "), _txt(7400000, my))).toDF(
        "source_file", "line_no", "value")
    return header.unionByName(a).unionByName(b)


def scan_scope_q(spark, sf):
    from ..sources.delimited import parse_scope
    return parse_scope(_scope_lines(spark, sf), swap_xy=True)


def _scan_scope_sql() -> str:
    mx = "(k*k*7919 + k*104729) % 199999"
    my = "(k*k*15485 + k*611953) % 199999"
    return f"""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT '{SCOPE_FILES[0]}' AS source_file, CAST(k // 2 + 2 AS BIGINT) AS seq, concat('W', CAST(k AS VARCHAR)) AS id,
       TRY_CAST({_txt_sql(7400000, my)} AS DOUBLE) AS x, TRY_CAST({_txt_sql(5900000, mx)} AS DOUBLE) AS y
FROM o WHERE k % 2 = 0
UNION ALL
SELECT '{SCOPE_FILES[1]}', CAST(k // 2 + 1 AS BIGINT), NULL,
       TRY_CAST({_txt_sql(7400000, my)} AS DOUBLE), TRY_CAST({_txt_sql(5900000, mx)} AS DOUBLE)
FROM o WHERE k % 2 = 1"""


def validate_files_q(spark, sf):
    from ..sources.delimited import file_status, parse_points
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    mx = (k * k * 7919 + k * 104729) % 199999
    bad_h = F.when(k % 8 == 4, F.lit("1d")).otherwise(_txt(100, (k * 31) % 5000))
    e = o.select(F.lit("pts_e.csv").alias("source_file"), (k + 1).alias("line_no"),
                                   F.concat_ws(";", k.cast("string"), _txt(5900000, mx), F.lit("7400000"), bad_h)
                                   .alias("value"))
    lines = _point_lines(spark, sf).unionByName(e)
    return file_status(parse_points(lines, on_bad="keep"))


def _validate_files_sql() -> str:
    return f"""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT '{POINT_FILES[0]}' AS source_file, count(*) AS n_rows, 0 AS n_bad FROM o WHERE k % 4 = 0
UNION ALL SELECT '{POINT_FILES[1]}', count(*), 0 FROM o WHERE k % 4 = 1
UNION ALL SELECT '{POINT_FILES[2]}', count(*), 0 FROM o WHERE k % 4 = 2
UNION ALL SELECT '{POINT_FILES[3]}', count(*), 0 FROM o WHERE k % 4 = 3 AND k % 13 <> 5
UNION ALL SELECT 'pts_e.csv', count(*), count(*) FILTER (WHERE k % 8 = 4) FROM o"""


NUMERIC_SQL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def decimal_comma_q(spark, sf):
    from ..functions.numeric import parse_number
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    mx = (k * k * 7919 + k * 104729) % 199999
    ip = (F.lit(5900000) + F.floor(mx / 100)).cast("string")
    t = (F.when(k % 7 == 0, _txt(5900000, mx, ","))
         .when(k % 7 == 1, _txt(5900000, mx))
         .when(k % 7 == 2, F.concat(F.lit(" +"), ip, F.lit(" ")))
         .when(k % 7 == 3, F.concat(ip, F.lit("e-2")))
         .when(k % 7 == 4, F.concat(_txt(5900000, mx), F.lit("d")))
         .when(k % 7 == 5, F.lit("NaN"))
         .otherwise(F.concat(F.lit("1_"), ip)))
    return o.select("k", t.alias("text")).select("k", "text", parse_number("text").alias("value"))


def _decimal_comma_sql() -> str:
    mx = "(k*k*7919 + k*104729) % 199999"
    ip = f"CAST(5900000 + ({mx}) // 100 AS VARCHAR)"
    t = (f"CASE k % 7 WHEN 0 THEN {_txt_sql(5900000, mx, ',')} WHEN 1 THEN {_txt_sql(5900000, mx)} "
         f"WHEN 2 THEN concat(' +', {ip}, ' ') WHEN 3 THEN concat({ip}, 'e-2') "
         f"WHEN 4 THEN concat({_txt_sql(5900000, mx)}, 'd') WHEN 5 THEN 'NaN' ELSE concat('1_', {ip}) END")
    return f"""WITH o AS (SELECT o_orderkey AS k FROM orders), t AS (SELECT k, {t} AS text FROM o)
SELECT k, text, CASE WHEN regexp_full_match(replace(text, ',', '.'), '{NUMERIC_SQL}')
                     THEN TRY_CAST(trim(replace(text, ',', '.')) AS DOUBLE) END AS value FROM t"""


# --- remaining inventory items -------------------------------------------------------------

def compare_pair_diff_q(spark, sf):
    return pl.compare(fx.inp(spark, sf), key="k", reference=fx.cmp(spark, sf),
                      heights=fx.heights_projected(spark, sf), max_distance=MAX_DISTANCE,
                      decimals=DECIMALS, tolerance=TOLERANCE, height_tolerance=TOLERANCE,
                      pair_service_diff=True, sort=False).select(
        "id_odniesienia", "diff_h_geoportal", "diff_h", "diff_h_geoportal_pair")


def _compare_pair_diff_sql() -> str:
    base = _service_sql(True)
    head, select = base.rsplit("SELECT ", 1)
    pair = q.rint_sql(q.diff_sql("ch", "h_ref", DECIMALS), DECIMALS)
    cols = select.rsplit("FROM withh", 1)[0].rstrip()
    return (head.rstrip() + f""",
res AS (SELECT {cols}, {pair} AS diff_h_geoportal_pair FROM withh)
SELECT id_odniesienia, diff_h_geoportal, diff_h, diff_h_geoportal_pair FROM res""")


EXTENSIONS = [".TXT", ".csv", ".xlsx", ".dat", ".XLS", ""]


def _file_names(k):
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (k % len(EXTENSIONS) + 1).cast("int"))
    return F.concat(F.lit("/data/survey."), (k % 7).cast("string"), F.lit("/pts_"), k.cast("string"), ext)


def file_format_q(spark, sf):
    from ..sources.delimited import extension
    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    e = extension(_file_names(F.col("k")))
    return o.select("k", e.alias("ext"),
                    F.when(e == ".xlsx", "workbook").when(e == ".xls", "unsupported")
                    .otherwise("delimited").alias("reader"))


def _file_format_sql() -> str:
    arr = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "]"
    name = f"concat('/data/survey.', CAST(k % 7 AS VARCHAR), '/pts_', CAST(k AS VARCHAR), {arr}[k % {len(EXTENSIONS)} + 1])"
    ext = f"lower(regexp_extract({name}, '(\\.[^./\\\\]+)$', 1))"
    return f"""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k, {ext} AS ext,
       CASE WHEN {ext} = '.xlsx' THEN 'workbook' WHEN {ext} = '.xls' THEN 'unsupported' ELSE 'delimited' END AS reader
FROM o"""


def all_zero_batches_q(spark, sf):
    from ..operators.lookup import all_zero_batches
    p = _inp_projected(spark, sf)
    k = F.col("k")
    h = F.when(F.floor(k / 300) % 5 == 0, F.lit(0.0)).otherwise(F.col("h"))
    a = p.select("n_cm", "e_cm", h.alias("h_ref"), F.lit(1).alias("pass_no"), F.floor(k / 300).alias("batch_no"),
                 (k % 300).cast("int").alias("pos"))
    return all_zero_batches(a)


def _all_zero_batches_sql() -> str:
    return (f"WITH {q.INP},\n" + INP_PROJ + """
SELECT 1 AS pass_no, floor(k/300) AS batch_no,
       bool_and((CASE WHEN floor(k/300) % 5 = 0 THEN 0.0e0 ELSE h END) = 0.0e0) AS all_zero
FROM ipk GROUP BY 2""")


def enrich_csv_q(spark, sf):
    from ..sinks.writers import enrich_for_csv
    return enrich_for_csv(enrich_xy_q(spark, sf))


# --- registry --------------------------------------------------------------------------------

def queries() -> dict[str, Query]:
    from . import catalog_rows, catalog_runs, catalog_space
    return {
        **catalog_rows.queries(),
        **catalog_runs.queries(),
        **catalog_space.queries(),
        "nearest_pair": nearest_pair_q,
        "nearest_unlimited": nearest_unlimited_q,
        "nearest_mutual": nearest_mutual_q,
        "compare_file": compare_file_q,
        "axis_roles": axis_roles_q,
        "zone_epsg": zone_epsg_q,
        "zone_counts": zone_counts_q,
        "zone_check": zone_check_q,
        "project_2180": project_2180_q,
        "height_key": height_key_q,
        "swap_axes": swap_axes_q,
        "decimal_comma": decimal_comma_q,
        "scan_delimited": scan_delimited_q,
        "scan_scope": scan_scope_q,
        "validate_files": validate_files_q,
        "height_lookup": height_lookup_q,
        "missing_heights": missing_heights_q,
        "height_diff": height_diff_q,
        "accuracy_flag": accuracy_flag_q,
        "result_rounding": result_rounding_q,
        "abs_sort": abs_sort_q,
        "compare_heights": compare_heights_q,
        "compare_both": compare_both_q,
        "enrich_xy": enrich_xy_q,
        "height_service": height_service_q,
        "parse_response": parse_response_q,
        "batch_requests": batch_requests_q,
        "last_batch_wins": last_batch_wins_q,
        "bbox": bbox_q,
        "points_in_polygon": points_in_polygon_q,
        "hex_grid": hex_grid_q,
        "radius_join": radius_join_q,
        "hex_thin": hex_thin_q,
        "thin_accurate": thin_accurate_q,
        "grid_heights": grid_heights_q,
        "run_metrics": run_metrics_q,
        "split_accuracy": split_accuracy_q,
        "geo_layer": geo_layer_q,
        "compare_pair_diff": compare_pair_diff_q,
        "file_format": file_format_q,
        "all_zero_batches": all_zero_batches_q,
        "enrich_csv": enrich_csv_q,
    }


def oracle_sql() -> dict[str, str]:
    from . import catalog_rows, catalog_runs, catalog_space
    inp_proj = f"WITH {q.INP},\n" + INP_PROJ
    return {
        **catalog_rows.oracle_sql(),
        **catalog_runs.oracle_sql(),
        **catalog_space.oracle_sql(),
        "nearest_pair": _nearest_sql(MAX_DISTANCE) + "\nSELECT id, cid, d FROM paired",
        "nearest_unlimited": _nearest_unlimited_sql(),
        "nearest_mutual": _nearest_mutual_sql(),
        "compare_file": _compare_file_sql(),
        "axis_roles": f"WITH {q.INP},\n{FIRST_ROW}\nSELECT k, gn AS geodetic_northing, ge AS geodetic_easting FROM roles",
        "zone_epsg": f"WITH {q.ZONED}\nSELECT k, {q.zone_sql('e')} AS zone, 2171 + {q.zone_sql('e')} AS epsg, "
                     f"2171 + {q.zone_sql('n')} AS epsg_of_northing FROM zoned",
        "zone_counts": f"WITH {q.ZONED}\nSELECT 2171 + {q.zone_sql('e')} AS epsg, count(*) AS n_points FROM zoned "
                       f"WHERE {q.zone_sql('e')} IS NOT NULL GROUP BY 1",
        "zone_check": _zone_check_sql(),
        "project_2180": f"WITH {q.ZONED},\n" + q.projection_ctes("zoned", "n", "e", "zone", name="zp")
                        + f"\nSELECT k, {q.rint_sql('e_1992', 2)} AS e_1992, {q.rint_sql('n_1992', 2)} AS n_1992 FROM zp",
        "height_key": inp_proj + "\nSELECT k, n_cm, e_cm FROM ipk",
        "swap_axes": f"WITH {q.INP}\nSELECT k, y AS x, x AS y FROM inp",
        "decimal_comma": _decimal_comma_sql(),
        "scan_delimited": _scan_delimited_sql(),
        "scan_scope": _scan_scope_sql(),
        "validate_files": _validate_files_sql(),
        "height_lookup": inp_proj + ",\n" + q.HTS_PROJ +
                         "\nSELECT p.k, t.h_ref FROM ipk p LEFT JOIN hts t ON t.n_cm = p.n_cm AND t.e_cm = p.e_cm",
        "missing_heights": inp_proj + ",\n" + q.HTS_PROJ +
                           "\nSELECT id AS id_odniesienia, x AS x_odniesienia, y AS y_odniesienia FROM ipk p"
                           "\nWHERE p.n_cm IS NOT NULL AND NOT EXISTS "
                           "(SELECT 1 FROM hts t WHERE t.n_cm = p.n_cm AND t.e_cm = p.e_cm)",
        "height_diff": _height_diff_sql(),
        "accuracy_flag": _accuracy_flag_sql(),
        "result_rounding": _result_rounding_sql(),
        "abs_sort": _abs_sort_sql(),
        "compare_heights": _service_sql(False),
        "compare_both": _service_sql(True),
        "enrich_xy": inp_proj + ",\n" + q.HTS_PROJ +
                     f"\nSELECT p.id, {q.rint_sql('p.x', 2)} AS x, {q.rint_sql('p.y', 2)} AS y, "
                     f"{q.rint_sql('t.h_ref', 1)} AS h FROM ipk p "
                     "LEFT JOIN hts t ON t.n_cm = p.n_cm AND t.e_cm = p.e_cm",
        "height_service": inp_proj + f"\nSELECT DISTINCT n_cm, e_cm, {TERRAIN_SQL} AS h_ref FROM ipk "
                          "WHERE n_cm IS NOT NULL",
        "parse_response": _parse_response_sql(),
        "batch_requests": _batch_requests_sql(),
        "last_batch_wins": _last_batch_wins_sql(),
        "bbox": f"WITH {q.INP}\nSELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM inp",
        "points_in_polygon": f"WITH {q.INP}\nSELECT k, {q.polygon_inside_sql('x', 'y')} AS inside FROM inp",
        "hex_grid": "WITH " + _grid_sql(SPACING_SQL) + "\nSELECT id, x, y FROM centres",
        "radius_join": _radius_join_sql(),
        "hex_thin": _hex_thin_sql(),
        "thin_accurate": _thin_accurate_sql(),
        "grid_heights": _grid_heights_sql(),
        "run_metrics": _run_metrics_sql(),
        "split_accuracy": _split_accuracy_sql(),
        "geo_layer": _geo_layer_sql(),
        "compare_pair_diff": _compare_pair_diff_sql(),
        "file_format": _file_format_sql(),
        "all_zero_batches": _all_zero_batches_sql(),
        "enrich_csv": inp_proj + ",\n" + q.HTS_PROJ +
                      f"\nSELECT p.id AS id_odniesienia, {q.rint_sql('p.x', 2)} AS x_odniesienia, "
                      f"{q.rint_sql('p.y', 2)} AS y_odniesienia, {q.rint_sql('t.h_ref', 1)} AS h_geoportal "
                      "FROM ipk p LEFT JOIN hts t ON t.n_cm = p.n_cm AND t.e_cm = p.e_cm",
    }
