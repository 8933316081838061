"""Spark session helpers.

The library never creates its own session inside an operator; callers pass
one in.  ``local_session`` exists for tests, the bench and the smoke entry.
"""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every session used with the library should carry.  AQE re-plans
# joins from runtime sizes, splits skewed shuffle partitions and coalesces
# small ones; the cell joins in ``operators.pairing`` rely on that.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Checkpoint files of DataFrames that went out of scope are removed.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "levelling") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    On a cluster the directory must be the shared one configured in
    ``spark.checkpoint.dir``; it is read from the session and never replaced.
    Only a local-mode session without that setting (tests, bench) gets a fresh
    scratch directory of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; set it to a shared folder of the cluster")
    path = tempfile.mkdtemp(prefix="levelling-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """Round-robin ``df`` over the default parallelism when it has fewer partitions.

    A small input stored as one file with one row group is read by one task;
    row-heavy work on it (projection, the cell join) would then run on one
    core.  Inputs above ``SPREAD_BYTES`` pass through unchanged, whatever the
    size of the cluster.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(size) <= SPREAD_BYTES and df.rdd.getNumPartitions() < n:
        return df.repartition(n)
    return df


SPREAD_BYTES = 512 << 20  # larger inputs are never dealt anew


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``levelling`` importable in Python workers (once per application).

    Operators that run Python inside tasks (``mapInPandas`` for the height
    service and workbooks) need the package on the workers; a zip of it is
    handed to ``SparkContext.addPyFile``, which distributes it to executors.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("levelling", os.path.relpath(full, pkg)))
    path = os.path.join(tempfile.mkdtemp(prefix="levelling-pyfiles-"), "levelling.zip")
    with open(path, "wb") as fh:
        fh.write(buf.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
