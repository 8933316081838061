"""Result sinks.

CSV: ``;`` separated with a header, missing values written as
``brak_danych``; the accurate / inaccurate split is one write partitioned by
a label column.  A result is run and stored once, and all its outputs are
written from the stored rows.  Spatial layers are Parquet
with a ``geometry STRUCT<x, y>`` (x = file y, y = file x, as in the
reference), a WKT column and EPSG codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import point_struct
from ..functions.numeric import source_epsg
from ..operators.accuracy import MISSING_TEXT, is_accurate
from ..operators.axes import first_row_decision
from .observed import result_counts, store_counted

# Output base names and layer names per mode, and the split labels.
BASE_NAMES = {"compare": "wynik", "thinned": "wynik_siatka", "enrich": "wynik_geoportal",
              "grid": "wynik_siatka_geoportal"}
LAYER_NAMES = {"compare": "wyniki", "thinned": "wynik_siatki", "enrich": "wyniki_geoportal",
               "grid": "siatka_geoportal"}
ACCURATE, INACCURATE = "dokladne", "niedokladne"
ENRICH_CSV_NAMES = {"id": "id_odniesienia", "x": "x_odniesienia", "y": "y_odniesienia", "h": "h_geoportal"}


def output_name(mode: int, base: str, extension: str) -> str:
    """``tryb-{mode}_{base}.{extension}``."""
    return f"tryb-{mode}_{base}.{extension}"


def with_split_label(result: DataFrame, flag: str = "osiaga_dokladnosc") -> DataFrame:
    """Add ``dokladnosc`` = dokladne / niedokladne (no flag counts as inaccurate)."""
    return result.withColumn("dokladnosc", F.when(is_accurate(flag), F.lit(ACCURATE)).otherwise(F.lit(INACCURATE)))


def plain_text(c: str) -> Column:
    """Number to text without an exponent: the shortest digits, at least one after the point.

    Numbers beyond 12 decimals or 26 digits keep Spark's own text.
    """
    exact = F.col(c).try_cast("decimal(38,12)").cast("string")
    short = F.regexp_replace(F.regexp_replace(exact, "0+$", ""), r"\.$", ".0")
    small = (F.abs(F.col(c)) < F.lit(1e-12)) & (F.col(c) != 0)
    return F.when(small | exact.isNull(), F.col(c).cast("string")).otherwise(short)


def csv_text(result: DataFrame) -> DataFrame:
    """The result as it is written: doubles as plain decimals."""
    return result.withColumns({f.name: plain_text(f.name) for f in result.schema.fields
                               if f.dataType.typeName() in ("double", "float")})


def _csv_writer(df: DataFrame):
    return (csv_text(df).write.mode("overwrite").option("sep", ";").option("header", True)
            .option("nullValue", MISSING_TEXT).option("emptyValue", ""))


def write_csv(result: DataFrame, path: str, split_by_accuracy: bool = True,
              flag: str = "osiaga_dokladnosc") -> dict[str, int]:
    """All rows to ``path``; with a flag column also ``path_split/dokladnosc=...``.

    The plan runs once: its rows are stored and counted, and both outputs are
    written from the stored rows.  Nothing is written for an empty result.
    Returns the counts of ``observed.result_counts``.
    """
    stored, counts = store_counted(result, result_counts(result, flag))
    if counts["n_rows"]:
        _csv_writer(stored).csv(path)
        if split_by_accuracy and flag in result.columns:
            _csv_writer(with_split_label(stored, flag)).partitionBy("dokladnosc").csv(path + "_split")
    return counts


def enrich_for_csv(result: DataFrame) -> DataFrame:
    """Modes 4/5: CSV column names."""
    return result.withColumnsRenamed({k: v for k, v in ENRICH_CSV_NAMES.items() if k in result.columns})


def spatial_layer(result: DataFrame, points: DataFrame, order, layer: str = "wyniki") -> DataFrame:
    """Points layer: geometry (x = file y, y = file x), WKT, per-row and layer EPSG.

    The layer EPSG is the zone of the first input row (parity); ``epsg`` is
    the zone of each row under the same axis roles.
    """
    xc = "x_odniesienia" if "x_odniesienia" in result.columns else "x"
    yc = "y_odniesienia" if "y_odniesienia" in result.columns else "y"
    roles, layer_epsg = first_row_decision(points, order, "x", "y")
    easting = yc if roles.easting == "y" else xc
    out = result.withColumns({
        "geometry": point_struct(F.col(yc), F.col(xc)),
        "wkt": F.format_string("POINT (%.2f %.2f)", F.col(yc), F.col(xc)),
        "epsg": source_epsg(easting),
        "epsg_layer": F.lit(layer_epsg).cast("int"),
        "layer": F.lit(layer),
    })
    return out


def split_layer(layer: DataFrame) -> DataFrame:
    """The layer as it is split by accuracy: with the export flag and the label."""
    return with_split_label(layer.withColumn("eksport", is_accurate("osiaga_dokladnosc")))


def write_layer(layer: DataFrame, path: str, split_by_accuracy: bool = True) -> None:
    """Parquet layer, and when flagged its accurate / inaccurate partitions.

    An empty layer, or one whose zone is unknown, is not written.  The plan runs
    once; both outputs are written from its stored rows.
    """
    layer = layer.checkpoint()
    first = layer.select("epsg_layer").first()
    if first is None or first["epsg_layer"] is None:
        return
    if split_by_accuracy and "osiaga_dokladnosc" in layer.columns:
        split_layer(layer).write.mode("overwrite").partitionBy("dokladnosc").parquet(path + "_split")
    layer.write.mode("overwrite").parquet(path)


def run_metrics(result: DataFrame) -> DataFrame:
    """One row of counts for a comparison result."""
    return result.agg(*result_counts(result))


def input_metrics(points: DataFrame | None = None, scope: DataFrame | None = None,
                  grid: DataFrame | None = None, candidates: DataFrame | None = None,
                  answers: DataFrame | None = None) -> DataFrame:
    """One row of counts of a run's inputs; a count whose table is not given is NULL.

    Rows loaded, scope vertices, grid centres, candidates inside the scope,
    keys asked again in the second pass and keys that pass recovered.
    """
    def count(df: DataFrame | None, name: str) -> DataFrame:
        if df is None:
            return None
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")

    again = found = None
    if answers is not None:
        second = answers.where(F.col("pass_no") == 2)
        again = second.select("n_cm", "e_cm").distinct()
        found = second.where(~F.col("failed")).select("n_cm", "e_cm").distinct()
    names = ["n_loaded", "n_vertices", "n_centres", "n_candidates", "n_retried", "n_recovered"]
    parts = [p for p in map(count, (points, scope, grid, candidates, again, found), names) if p is not None]
    if not parts:
        raise ValueError("give at least one table")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for n in names])


def qa_outputs(projected: DataFrame, heights: DataFrame, centres: DataFrame | None = None) -> dict[str, DataFrame]:
    """Debug tables: projected coordinates, points without a height, grid centres (``seq_no``, x, y)."""
    from ..operators.lookup import missing_heights
    out = {
        "projected": projected.select(F.col("id").alias("id_punktu"), F.col("e_1992").alias("x_2180"),
                                      F.col("n_1992").alias("y_2180")),
        "without_height": missing_heights(projected, heights).select(
            F.col("id").alias("id_odniesienia"), F.col("x").alias("x_odniesienia"),
            F.col("y").alias("y_odniesienia")),
    }
    if centres is not None:
        out["grid_centres"] = centres.select(
            F.concat(F.lit("s_"), F.col("seq_no").cast("string")).alias("id"), "x", "y")
    return out
