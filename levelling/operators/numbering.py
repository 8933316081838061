"""Gap-free sequential numbering without a single-partition window.

``row_number()`` over an unpartitioned window moves every row into one task.
Instead the rows are range-partitioned on the order columns and sorted
within partitions; ``monotonically_increasing_id`` then encodes (partition,
position).  Per-partition counts (one row per partition) give the offsets,
which are joined back as a small broadcast table.  The ranged data is
checkpointed first so that the counting job and the numbering job see the
same partitions even if tasks are recomputed.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_POS_BITS = 33


def sequential_index(df: DataFrame, order: Sequence[str], out: str = "row_no",
                     partitions: int | None = None, start: int = 1) -> DataFrame:
    """Add ``out`` = 1-based position of each row in ``order`` (must be a total order)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index_in_place(df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order])
                          .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order]), out, start)


def index_in_place(df: DataFrame, out: str = "row_no", start: int = 1) -> DataFrame:
    """Add ``out`` = position of each row, for rows whose partitions already follow the order."""
    spark = df.sparkSession
    ranged = df.withColumn("__mid", F.monotonically_increasing_id()).checkpoint()
    pid = F.shiftright(F.col("__mid"), _POS_BITS)
    counts = sorted((r["p"], r["c"]) for r in
                    ranged.groupBy(pid.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect())
    offsets = list(accumulate([c for _, c in counts], initial=0))[:-1]
    table = spark.createDataFrame([(p, o) for (p, _), o in zip(counts, offsets)] or [(0, 0)],
                                  "p long, o long")
    pos = F.col("__mid") - F.shiftleft(F.col("p"), _POS_BITS)
    return (ranged.withColumn("p", pid)
            .join(F.broadcast(table), "p")  # one row per partition
            .withColumn(out, F.col("o") + pos + F.lit(start))
            .drop("__mid", "p", "o"))
