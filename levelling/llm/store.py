"""Intermediate tables in the shared folder of the session.

``stash`` writes a DataFrame as Parquet under the session's checkpoint folder
(``spark.checkpoint.dir``) and reads it back: lineage is cut, the copy is
compressed, and a lost executor costs nothing that was already written.  The
folder of one application is ``<checkpoint dir>/llm-<application id>``; it can
be removed when the application has ended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from levelling.session import ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder set, package on the Python workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    root = ensure_checkpoint_dir(spark)
    return f"{root}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new shared table and return that table."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
