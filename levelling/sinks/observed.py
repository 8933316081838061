"""Run counts taken by the execution that stores a result.

``store_counted`` runs the plan of a result once: its rows go to the checkpoint
folder and are counted on the way (``DataFrame.observe``), so neither the counts
nor the outputs written from the stored rows run the plan again.

The counting node is the last one of the plan.  Its stage writes the checkpoint,
and Spark counts each of its tasks once, however often a task was tried.  A
result that is empty has counts of zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def result_counts(result: DataFrame, flag: str = "osiaga_dokladnosc") -> list[Column]:
    """Counts of a comparison result; those whose column is absent are left out, ``n_paired`` is 0 then."""
    paired = F.count("id_porownania") if "id_porownania" in result.columns else F.lit(0).cast("long")
    counts = [F.count(F.lit(1)).alias("n_rows"), paired.alias("n_paired")]
    if flag in result.columns:
        counts += [F.count(F.when(F.col(flag) == "Tak", 1)).alias("n_accurate"),
                   F.count(F.when(F.col(flag) == "Nie", 1)).alias("n_inaccurate"),
                   F.count(F.when(F.col(flag).isNull(), 1)).alias("n_unflagged")]
    return counts


def store_counted(df: DataFrame, counts: Sequence[Column]) -> tuple[DataFrame, dict[str, int]]:
    """The stored rows of ``df`` and its counts, both from one execution."""
    taken = Observation()
    stored = df.observe(taken, *counts).checkpoint()
    return stored, taken.get
