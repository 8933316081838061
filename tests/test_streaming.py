import os

from pyspark.sql import functions as F

from levelling.operators.axes import Roles
from levelling.plans.pipelines import compare
from levelling.sources import fixtures as fx
from levelling.streaming.compare import heights_stream, start_compare_stream

SF = "/root/testdata/sf0.001"
SCHEMA = "id string, x double, y double, h double, k long"


def _write_parts(spark, d):
    pts = fx.inp(spark, SF)
    pts.where(F.col("k") < 700).write.parquet(os.path.join(d, "in", "p1"))
    pts.where(F.col("k") >= 700).write.parquet(os.path.join(d, "in", "p2"))
    return os.path.join(d, "in", "*")


def test_compare_stream_equals_batch(spark, tmpdir_fresh):
    src = _write_parts(spark, tmpdir_fresh)
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    sink = os.path.join(tmpdir_fresh, "out")
    q = start_compare_stream(stream, sink, key="k", reference=fx.cmp(spark, SF), max_distance=15.0,
                             checkpoint_location=os.path.join(tmpdir_fresh, "ckpt"),
                             trigger={"availableNow": True})
    q.awaitTermination(300)
    got = spark.read.parquet(sink).drop("batch_id")
    want = compare(fx.inp(spark, SF), key="k", reference=fx.cmp(spark, SF), max_distance=15.0, keep=["k"])
    assert got.count() == 1500
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_heights_stream(spark, tmpdir_fresh):
    src = _write_parts(spark, tmpdir_fresh)
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    s = heights_stream(stream, fx.heights_projected(spark, SF), Roles("x", "y"))
    q = (s.writeStream.format("memory").queryName("hstream").outputMode("append")
         .trigger(availableNow=True).option("checkpointLocation", os.path.join(tmpdir_fresh, "c2")).start())
    q.awaitTermination(300)
    got = spark.table("hstream")
    assert got.count() == 1500
    assert got.where(F.col("h_ref").isNotNull()).count() == fx.heights_projected(spark, SF).count()
