"""SQL text for the DuckDB oracles: the derived fixture tables and the
rounding / projection formulas written independently in SQL."""

from __future__ import annotations

from ..functions import projection as pj
from ..sources.fixtures import SCOPE_POLYGON

INP = """inp AS (
  SELECT concat('P_', CAST(o_orderkey AS VARCHAR)) AS id,
         5900000 + ((o_orderkey*o_orderkey*7919 + o_orderkey*104729) % 199999)/100.0e0 AS x,
         7400000 + ((o_orderkey*o_orderkey*15485 + o_orderkey*611953) % 199999)/100.0e0 AS y,
         100 + ((o_orderkey*31) % 5000)/100.0e0 AS h,
         o_orderkey AS k
  FROM orders)"""

CMP = """cmp AS (
  SELECT concat('C_', CAST(k AS VARCHAR)) AS id,
         x + (((k*37) % 41) - 20)/100.0e0 AS x,
         y + (((k*53) % 41) - 20)/100.0e0 AS y,
         h + (((k*13) % 81) - 40)/100.0e0 AS h, k
  FROM inp WHERE k % 3 <> 0)"""

ZONED = """zoned AS (
  SELECT o_orderkey AS k,
         5430000 + ((o_orderkey*o_orderkey*7919 + o_orderkey*104729) % 65000000)/100.0e0 AS n,
         (5 + o_orderkey % 4)*1000000 + 400000
           + ((o_orderkey*o_orderkey*15485 + o_orderkey*611953) % 20000000)/100.0e0 AS e,
         CAST(5 + o_orderkey % 4 AS INTEGER) AS zone
  FROM orders)"""

H_REF = "CASE WHEN k % 97 = 0 THEN 0.0e0 ELSE h + (((k*17) % 61) - 30)/100.0e0 END"


def f(v: float) -> str:
    """Double literal DuckDB will not read as DECIMAL."""
    return f"{float(v)!r}e0" if "e" not in repr(float(v)) else repr(float(v))


def rint_sql(v: str, n: int) -> str:
    s = f(10.0 ** n)
    return f"(round_even(({v})*{s}, 0)/{s})"


def py_round_sql(v: str, n: int) -> str:
    s = f(10.0 ** n)
    t = f"(({v})*{s})"
    c = f"(({v})*134217729.0e0)"
    hi = f"({c} - ({c} - ({v})))"
    e = f"((({hi})*{s} - {t}) + (({v}) - {hi})*{s})"
    k = f"floor({t})"
    r = f"(({t} - {k} - 0.5e0) + {e})"
    return (f"((CASE WHEN {r} > 0 THEN {k} + 1 WHEN {r} < 0 THEN {k} "
            f"WHEN ({k} % 2) = 0 THEN {k} ELSE {k} + 1 END)/{s})")


def no_neg_zero_sql(v: str) -> str:
    return f"(CASE WHEN ({v}) = 0 THEN 0.0e0 ELSE ({v}) END)"


def diff_sql(a: str, b: str, n: int) -> str:
    return no_neg_zero_sql(py_round_sql(f"({a}) - ({b})", n))


def flag_sql(v: str, tol: float) -> str:
    return f"(CASE WHEN ({v}) IS NULL THEN NULL WHEN abs({v}) <= {f(tol)} THEN 'Tak' ELSE 'Nie' END)"


def cm_sql(v: str) -> str:
    return f"CAST(round_even(({v})*100.0e0, 0) AS BIGINT)"


def projection_ctes(src: str, n: str, e: str, zone: str, name: str = "proj", carry: str = "*") -> str:
    """CTE chain ``{name}`` = ``src`` plus e_1992 / n_1992 columns."""
    k0a_src = f(pj.K0_2000 * pj.RECT_A)
    k0a_dst = f(pj.K0_1992 * pj.RECT_A)
    xi_p, eta_p = "xi", "eta"
    for j, b in enumerate(pj.BETA, start=1):
        xi_p += f" - {f(b)}*sin({f(2 * j)}*xi)*cosh({f(2 * j)}*eta)"
        eta_p += f" - {f(b)}*cos({f(2 * j)}*xi)*sinh({f(2 * j)}*eta)"
    n_sum, e_sum = "xf", "ef"
    for j, a in enumerate(pj.ALPHA, start=1):
        n_sum += f" + {f(a)}*sin({f(2 * j)}*xf)*cosh({f(2 * j)}*ef)"
        e_sum += f" + {f(a)}*cos({f(2 * j)}*xf)*sinh({f(2 * j)}*ef)"
    inf = "'Infinity'::DOUBLE"
    return f"""{name}_1 AS (
  SELECT {carry}, ({n})/{k0a_src} AS xi,
         (({e}) - (CAST({zone} AS DOUBLE)*1000000.0e0 + 500000.0e0))/{k0a_src} AS eta,
         radians(CAST({zone} AS DOUBLE)*3.0e0 - 19.0e0) AS shift
  FROM {src}),
{name}_2 AS (SELECT *, {xi_p} AS xip, {eta_p} AS etap FROM {name}_1),
{name}_3 AS (SELECT *, atan2(sin(xip), sqrt(sinh(etap)*sinh(etap) + cos(xip)*cos(xip))) AS chi,
                atan2(sinh(etap), cos(xip)) + shift AS dlam FROM {name}_2),
{name}_4 AS (SELECT *, atan2(tan(chi), cos(dlam)) AS xf, atanh(cos(chi)*sin(dlam)) AS ef FROM {name}_3),
{name}_5 AS (SELECT *, {f(pj.FE_1992)} + {k0a_dst}*({e_sum}) AS e_raw,
                {f(pj.FN_1992)} + {k0a_dst}*({n_sum}) AS n_raw FROM {name}_4),
{name} AS (SELECT * EXCLUDE (xi, eta, shift, xip, etap, chi, dlam, xf, ef, e_raw, n_raw),
             CASE WHEN abs(e_raw) < {inf} THEN e_raw END AS e_1992,
             CASE WHEN abs(n_raw) < {inf} THEN n_raw END AS n_1992 FROM {name}_5)"""


def zone_sql(e: str) -> str:
    t = f"TRY_CAST(trunc({e}) AS BIGINT)"
    return f"(CASE WHEN {t} BETWEEN 5000000 AND 8999999 THEN CAST(floor({t}/1000000) AS INTEGER) END)"


def polygon_inside_sql(px: str, py: str, vertices=SCOPE_POLYGON) -> str:
    pts = [(float(x), float(y)) for x, y in vertices]
    terms = []
    for i in range(len(pts)):
        x0, y0 = pts[i]
        x1, y1 = pts[(i + 1) % len(pts)]
        f0 = f"({f(y0)} >= {py})"
        f1 = f"({f(y1)} >= {py})"
        side = f"((({f(y1)} - {py})*({f(x0)} - {f(x1)})) >= (({f(x1)} - {px})*({f(y0)} - {f(y1)})))"
        terms.append(f"CAST(({f0} <> {f1}) AND ({side} = {f1}) AS INTEGER)")
    return f"((({' + '.join(terms)}) % 2) = 1)"


HTS_PROJ = (projection_ctes("(SELECT *, 7 AS zone FROM inp WHERE k % 11 <> 0)", "x", "y", "zone",
                            name="hp") +
            f""",
hts AS (SELECT {cm_sql('n_1992')} AS n_cm, {cm_sql('e_1992')} AS e_cm, max({H_REF}) AS h_ref
        FROM hp GROUP BY 1, 2)""")
