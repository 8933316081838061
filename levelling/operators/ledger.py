"""Request ledger: what was asked of a height service, kept so that a run can go on where it ended.

Distinct keys are stored once, dealt by hash into ``slices``.  Every pass over a
slice is one Spark job that writes one row per key asked (key, pass, batch,
outcome, height) to a folder of its own; the folder counts once Spark has marked
it complete.  A later pass asks only the keys that the pass before left open,
which its own rows tell: no join.  A run that is started again with the same
folder skips what is complete, so after a failure at most one slice of one pass
is asked again; after a lost executor only the batches of its tasks.

Keys of a slice are sorted by range, so a batch covers neighbouring points.

Outcomes: ``answered`` (with a height, 0.0 included), ``left out`` (the batch was
answered without the key) and ``failed`` (every attempt at the batch failed).
Keys with a null part are not asked; an empty table of keys gives an empty
ledger; heights for keys that were not asked are ignored; of several heights
for a key in one answer the last counts.  A folder belongs to one table of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lookup import BATCH_SIZE, KEY, MAX_ATTEMPTS, MAX_REQUESTS, REQUEST_TASKS, fetch_with_retry

SCHEMA = "n_cm long, e_cm long, pass_no int, batch_no long, outcome string, h_ref double"
ANSWERED, LEFT_OUT, FAILED = "answered", "left out", "failed"
SLICES = 8


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether Spark finished writing the folder."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def _asking(fetch, pass_no: int, batch_size: int, attempts: int, threads: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32  # batch numbers differ between tasks
        with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
            for pdf in it:
                keys = list(zip(pdf["n_cm"].tolist(), pdf["e_cm"].tolist()))
                parts = [keys[i:i + batch_size] for i in range(0, len(keys), batch_size)]
                answers = pool.map(lambda b: fetch_with_retry(fetch, b, attempts),
                                   [[(e / 100.0, n / 100.0) for n, e in p] for p in parts])
                for part, answer in zip(parts, answers):
                    found = {(n, e): h for n, e, h in answer}
                    missing = LEFT_OUT if answer else FAILED
                    yield pd.DataFrame({
                        "n_cm": [n for n, _ in part], "e_cm": [e for _, e in part], "pass_no": pass_no,
                        "batch_no": number, "outcome": [ANSWERED if k in found else missing for k in part],
                        "h_ref": pd.Series([found.get(k) for k in part], dtype="float64")})
                    number += 1
    return run


def ask_all(keys: DataFrame, fetch: Callable[[list[tuple[float, float]]], str], folder: str, *,
            passes: int = 2, slices: int = SLICES, tasks: int = REQUEST_TASKS, batch_size: int = BATCH_SIZE,
            attempts: int = MAX_ATTEMPTS, threads_per_task: int | None = None) -> DataFrame:
    """Ask for every key of ``keys`` until it is answered, at most ``passes`` times; all rows of the ledger.

    ``folder`` must be shared by the cluster.  Limits as in ``lookup.fetch_answers``.
    """
    from ..session import ship_package
    spark = keys.sparkSession
    ship_package(spark)
    threads = threads_per_task or max(1, MAX_REQUESTS // tasks)
    store = f"{folder}/keys"
    if not _complete(spark, store):
        (keys.select(*KEY).dropna().distinct()
         .withColumn("slice", F.pmod(F.xxhash64(*KEY), F.lit(slices)).cast("int"))
         .write.mode("overwrite").partitionBy("slice").parquet(store))
    given = spark.read.schema("n_cm long, e_cm long, slice int").parquet(store)
    for pass_no in range(1, passes + 1):
        for s in range(slices):
            path = _folder(folder, pass_no, s)
            if _complete(spark, path):
                continue
            todo = given.where(F.col("slice") == s) if pass_no == 1 else (
                spark.read.schema(SCHEMA).parquet(_folder(folder, pass_no - 1, s)).where(F.col("outcome") != ANSWERED))
            (todo.select(*KEY).repartitionByRange(tasks, *KEY).sortWithinPartitions(*KEY)
             .mapInPandas(_asking(fetch, pass_no, batch_size, attempts, threads), SCHEMA)
             .write.mode("overwrite").parquet(path))
    return ledger(spark, folder, passes, slices)


def _folder(folder: str, pass_no: int, s: int) -> str:
    return f"{folder}/pass-{pass_no}/slice-{s}"


def ledger(spark: SparkSession, folder: str, passes: int = 2, slices: int = SLICES) -> DataFrame:
    """All complete rows of a ledger folder."""
    paths = [_folder(folder, p, s) for p in range(1, passes + 1) for s in range(slices)]
    done = [p for p in paths if _complete(spark, p)]
    return spark.read.schema(SCHEMA).parquet(*done) if done else spark.createDataFrame([], SCHEMA)


def key_status(rows: DataFrame) -> DataFrame:
    """Per key: ``passes`` it was asked in, its last ``outcome`` and its height (NULL while open)."""
    return rows.groupBy(*KEY).agg(F.max("pass_no").alias("passes"), F.max_by("outcome", "pass_no").alias("outcome"),
                                  F.max_by("h_ref", "pass_no").alias("h_ref"))


def ledger_counts(rows: DataFrame) -> DataFrame:
    """One row: keys asked, asked again, recovered by a later pass and still open."""
    status = key_status(rows)
    answered = F.col("outcome") == ANSWERED
    return status.agg(F.count(F.lit(1)).alias("n_asked"), F.count_if(F.col("passes") > 1).alias("n_retried"),
                      F.count_if((F.col("passes") > 1) & answered).alias("n_recovered"),
                      F.count_if(~answered).alias("n_open"))
