import glob
import os

from pyspark.sql import functions as F

import __spark_entry__ as se
from levelling.plans import catalog
from levelling.sinks.writers import output_name, spatial_layer, write_csv, write_layer
from levelling.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() == 1500
    assert df.columns[:4] == ["id_odniesienia", "x_odniesienia", "y_odniesienia", "h_odniesienia"]


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(se.queries()) and set(se.oracle_sql()) <= set(se.queries())


def test_fixture_anchor_counts(spark):
    res = catalog.compare_file_q(spark, SF)
    assert res.where(F.col("id_porownania").isNotNull()).count() == 1071
    assert res.where(F.col("osiaga_dokladnosc") == "Tak").count() == 501
    assert fx.heights_native(spark, SF).count() == 1363


def test_csv_split_and_names(spark, tmpdir_fresh):
    res = catalog.compare_file_q(spark, SF)
    path = os.path.join(tmpdir_fresh, output_name(1, "wynik", "csv"))
    write_csv(res, path)
    assert path.endswith("tryb-1_wynik.csv")
    full = spark.read.option("sep", ";").option("header", True).csv(path)
    assert full.count() == 1500
    assert full.where(F.col("id_porownania") == "brak_danych").count() == 1500 - 1071
    split = spark.read.option("sep", ";").option("header", True).csv(path + "_split")
    counts = {r[0]: r[1] for r in split.groupBy("dokladnosc").count().collect()}
    assert counts == {"dokladne": 501, "niedokladne": 999}
    assert glob.glob(os.path.join(path + "_split", "dokladnosc=dokladne", "*.csv"))


def test_spatial_layer(spark, tmpdir_fresh):
    res = catalog.compare_heights_q(spark, SF)
    layer = spatial_layer(res, fx.inp(spark, SF), order="k")
    row = layer.first()
    assert row["geometry"]["x"] == row["y_odniesienia"] and row["geometry"]["y"] == row["x_odniesienia"]
    assert row["epsg_layer"] == 2178 and row["epsg"] == 2178
    path = os.path.join(tmpdir_fresh, "layer")
    write_layer(layer, path)
    assert spark.read.parquet(path).count() == 1500


def test_fixture_anchor_counts_sf001(spark):
    sf = "/root/testdata/sf0.01"
    res = catalog.compare_file_q(spark, sf).checkpoint()
    assert res.where(F.col("id_porownania").isNotNull()).count() == 14128
    assert res.where(F.col("osiaga_dokladnosc") == "Tak").count() == 5027
    assert catalog.nearest_mutual_q(spark, sf).count() == 9996
    h = fx.heights_projected(spark, sf)
    assert h.count() == 13636 and h.where(F.col("h_ref") == 0.0).count() == 140
    assert catalog.compare_heights_q(spark, sf).where(F.col("osiaga_dokladnosc") == "Tak").count() == 9072
