"""Point tables derived from the driver's parquet data (FIXTURES.md section 3).

The generator expressions use integer arithmetic and one division by a
double, so Spark and DuckDB produce bit-identical coordinates.  Each
function returns a lazy DataFrame over ``orders``; its size grows with the
scale factor of the input directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projection import project_2000_to_1992
from ..session import spread

# Vertices (x, y) of the concave scope polygon in ring order,
# and its grid spacing.
SCOPE_POLYGON = [
    (5900100.0, 7400100.0),
    (5901900.0, 7400300.0),
    (5901500.0, 7401000.0),
    (5901800.0, 7401900.0),
    (5900900.0, 7401500.0),
    (5900200.0, 7401800.0),
]
SCOPE_SPACING = 25.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _hundredths(expr):
    return expr.cast("double") / F.lit(100.0)


def _scattered(k, a: int, b: int):
    """``(k * k * a + k * b) % 199999``; large keys by their remainder, which gives the same where a long held the product."""
    r = F.when(k.between(-10_000_000, 10_000_000), k).otherwise(F.pmod(k, F.lit(199999)))
    return (r * r * a + r * b) % 199999


def inp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input points (zone 7), columns id, x, y, h, k."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("P_"), k.cast("string")).alias("id"),
        (F.lit(5900000.0) + _hundredths(_scattered(k, 7919, 104729))).alias("x"),
        (F.lit(7400000.0) + _hundredths(_scattered(k, 15485, 611953))).alias("y"),
        (F.lit(100.0) + _hundredths((k * 31) % 5000)).alias("h"),
        k.alias("k"),
    )


def cmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison points: two thirds of ``inp``, jittered; columns id, x, y, h, k."""
    k = F.col("k")
    return inp(spark, sf_dir).where(k % 3 != 0).select(
        F.concat(F.lit("C_"), k.cast("string")).alias("id"),
        (F.col("x") + _hundredths((k * 37) % 41 - 20)).alias("x"),
        (F.col("y") + _hundredths((k * 53) % 41 - 20)).alias("y"),
        (F.col("h") + _hundredths((k * 13) % 81 - 40)).alias("h"),
        k,
    )


def _reference_height():
    k = F.col("k")
    return F.when(k % 97 == 0, F.lit(0.0)).otherwise(F.col("h") + _hundredths((k * 17) % 61 - 30))


def heights_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height table keyed by the input's own axes in whole centimetres."""
    p = inp(spark, sf_dir).where(F.col("k") % 11 != 0)
    return (p.select(F.rint(F.col("x") * 100).cast("bigint").alias("n_cm"),
                     F.rint(F.col("y") * 100).cast("bigint").alias("e_cm"),
                     _reference_height().alias("h_ref"))
            .groupBy("n_cm", "e_cm").agg(F.max("h_ref").alias("h_ref")))


def heights_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height table keyed by EPSG 2180 coordinates of ``inp`` (n_cm, e_cm, h_ref).

    Stands in for the terrain-height service in end-to-end pipelines.
    """
    p = inp(spark, sf_dir).where(F.col("k") % 11 != 0).withColumn("zone", F.lit(7))
    p = project_2000_to_1992(p, "x", "y", "zone")
    return (p.select(F.rint(F.col("n_1992") * 100).cast("bigint").alias("n_cm"),
                     F.rint(F.col("e_1992") * 100).cast("bigint").alias("e_cm"),
                     _reference_height().alias("h_ref"))
            .groupBy("n_cm", "e_cm").agg(F.max("h_ref").alias("h_ref")))


def zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points spread over the four PL-2000 zones: k, n, e, zone."""
    k = F.col("o_orderkey")
    zone = F.lit(5) + k % 4
    return table(spark, sf_dir, "orders").select(
        k.alias("k"),
        (F.lit(5430000.0) + _hundredths((k * k * 7919 + k * 104729) % 65000000)).alias("n"),
        (zone.cast("double") * F.lit(1000000.0) + F.lit(400000.0)
         + _hundredths((k * k * 15485 + k * 611953) % 20000000)).alias("e"),
        zone.cast("int").alias("zone"),
    )


def scope_polygon(spark: SparkSession) -> DataFrame:
    """The scope polygon as a vertex table (seq, x, y)."""
    return spark.createDataFrame([(i + 1, x, y) for i, (x, y) in enumerate(SCOPE_POLYGON)],
                                 "seq int, x double, y double")
