"""Registered queries on whole runs: counts taken while writing, files read back, the request ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from ..session import ensure_checkpoint_dir
from ..sinks.observed import result_counts, store_counted
from ..sinks.writers import write_csv
from ..sources import fixtures as fx
from . import catalog as base
from . import sqltext as q

BAND = 2000     # centimetres of northing in one file of the height table that answers requests
SILENT = 11     # northings divisible by it are never answered


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_metrics_observed_q(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a comparison, taken by the execution that stores it."""
    result = base.compare_file_q(spark, sf)
    _, counts = store_counted(result, result_counts(result))
    return spark.createDataFrame([counts], ", ".join(f"{n} long" for n in counts))


def csv_files_q(spark: SparkSession, sf: str) -> DataFrame:
    """The split files of a comparison, read back."""
    path = _folder(spark, "csv")
    write_csv(base.compare_file_q(spark, sf), path)
    back = spark.read.option("sep", ";").option("header", True).csv(path + "_split")
    return back.select("id_odniesienia", "id_porownania", "dokladnosc")


def _csv_files_sql() -> str:
    head, select = base._compare_file_sql().rsplit("SELECT ", 1)
    return (head.rstrip() + f""",
res AS (SELECT {select})
SELECT id_odniesienia, coalesce(id_porownania, 'brak_danych') AS id_porownania,
       CASE WHEN coalesce(lower(trim(osiaga_dokladnosc)) = 'tak', false) THEN 'dokladne' ELSE 'niedokladne' END
         AS dokladnosc FROM res""")


class TableService:
    """A height service that answers from a table stored in bands of northing, and stays silent for some keys."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batch):
        import pyarrow.dataset as ds
        asked = {(round(n * 100), round(e * 100)) for e, n in batch}
        bands = sorted({n // BAND for n, _ in asked})
        table = ds.dataset(self.folder, partitioning="hive").to_table(
            filter=ds.field("band").isin(bands), columns=["n_cm", "e_cm", "h_ref"])
        rows = zip(*(table[c].to_pylist() for c in ("n_cm", "e_cm", "h_ref")))
        return ",".join(f"{n / 100:.2f} {e / 100:.2f} {h!r}" for n, e, h in rows
                        if (n, e) in asked and n % SILENT)


def height_retry_q(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct key of the input with the passes it was asked in, its outcome and height."""
    table = _folder(spark, "bands")
    (fx.heights_projected(spark, sf).select("n_cm", "e_cm", "h_ref", F.floor(F.col("n_cm") / BAND).cast("int").alias("band"))
     .where("h_ref is not null").repartition("band").write.partitionBy("band").parquet(table))
    rows = ledger.ask_all(base._inp_projected(spark, sf), TableService(table), _folder(spark, "ledger"), slices=2)
    status = ledger.key_status(rows)
    return status.select("n_cm", "e_cm", "passes", (F.col("outcome") == ledger.ANSWERED).alias("answered"), "h_ref")


def _height_retry_sql() -> str:
    return (f"WITH {q.INP},\n" + base.INP_PROJ + ",\n" + q.HTS_PROJ + f""",
keys AS (SELECT DISTINCT n_cm, e_cm FROM ipk WHERE n_cm IS NOT NULL AND e_cm IS NOT NULL),
got AS (SELECT k.n_cm, k.e_cm, t.h_ref FROM keys k LEFT JOIN hts t ON t.n_cm = k.n_cm AND t.e_cm = k.e_cm AND k.n_cm % {SILENT} <> 0)
SELECT n_cm, e_cm, CASE WHEN h_ref IS NULL THEN 2 ELSE 1 END AS passes, h_ref IS NOT NULL AS answered, h_ref FROM got""")


def queries():
    return {"run_metrics_observed": run_metrics_observed_q, "csv_files": csv_files_q, "height_retry": height_retry_q}


def oracle_sql() -> dict[str, str]:
    return {"run_metrics_observed": base._run_metrics_sql(), "csv_files": _csv_files_sql(),
            "height_retry": _height_retry_sql()}
