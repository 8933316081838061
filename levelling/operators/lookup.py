"""Terrain-height lookup.

Heights are keyed by EPSG 2180 coordinates in whole centimetres
(``n_cm``, ``e_cm``).  Two sources are supported:

* a height table -- a plain left equi-join on the key (Spark chooses
  broadcast or sort-merge from runtime sizes);
* a caller-supplied ``fetch(points) -> text`` function standing for the batch
  service.  Distinct keys are spread over tasks, each task cuts its rows into
  requests of at most 300 points and applies the retry policy; missing keys
  get a second pass; the last answer per key wins.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from http.client import HTTPException

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import NUMERIC_TEXT

# Fixed values of the service protocol.
BATCH_SIZE = 300
MAX_ATTEMPTS = 5
MAX_REQUESTS = 50  # concurrent requests of the whole job
REQUEST_TASKS = 10

KEY = ["n_cm", "e_cm"]
RESULT_SCHEMA = "n_cm long, e_cm long, h_ref double, pass_no int, batch_no long, pos int, failed boolean"


def centimetres(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    cm = F.rint(c * F.lit(100.0))
    return F.when(F.abs(cm) < F.lit(9.0e18), cm).try_cast("bigint")


def with_height_key(df: DataFrame, e: str = "e_1992", n: str = "n_1992") -> DataFrame:
    """Add the integer-centimetre lookup key of projected coordinates."""
    return df.withColumns({"n_cm": centimetres(n), "e_cm": centimetres(e)})


def cm_text(c: Column | str) -> Column:
    """Exact ``%.2f`` text of a centimetre integer (no float formatting)."""
    c = F.col(c) if isinstance(c, str) else c
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(c)
    return F.concat(sign, F.floor(a / 100).cast("string"), F.lit("."),
                    F.lpad((a % 100).cast("string"), 2, "0"))


def join_heights(points: DataFrame, heights: DataFrame, out: str = "h_ref",
                 zero_is_missing: bool = False, order: str | None = None) -> DataFrame:
    """Left join of keyed points with a height table; every point stays one row.

    Of several rows with one key the last in ``order`` counts, without an
    order column the greatest height.  The reduction shuffles the table on
    the join key, so the join needs no further exchange of that side.
    """
    last = F.max_by("h_ref", F.col(order)) if order else F.max("h_ref")
    h = heights.groupBy(*KEY).agg(last.alias(out))
    if zero_is_missing:
        h = h.where(F.col(out) != 0.0)
    return points.join(h, KEY, "left")


def missing_heights(points: DataFrame, heights: DataFrame) -> DataFrame:
    """Projected points the height source has no value for (anti join)."""
    return points.where(F.col("n_cm").isNotNull()).join(heights.select(*KEY), KEY, "left_anti")


def parse_response(df: DataFrame, text: str = "response", keep: Sequence[str] = ()) -> DataFrame:
    """Service answer ``"n e h,n e h,..."`` to rows (n_cm, e_cm, h_ref, pos).

    White space of any kind separates tokens.  Entries without exactly three
    tokens are skipped; an unparsable height reads as 0.0, as in the
    reference, and only plain decimal or exponent notation parses.
    """
    def number(c: Column) -> Column:
        return F.when(c.rlike(NUMERIC_TEXT), c.try_cast("double"))

    rows = df.select(*keep, F.posexplode(F.split(F.col(text), ",")).alias("pos", "entry"))
    bare = F.regexp_replace(F.col("entry"), r"^\s+|\s+$", "")
    rows = rows.withColumn("__t", F.split(bare, r"\s+")).where(F.size("__t") == 3)
    n, e = number(F.col("__t")[0]), number(F.col("__t")[1])
    h = F.coalesce(number(F.col("__t")[2]), F.lit(0.0))
    return rows.select(*keep, centimetres(n).alias("n_cm"), centimetres(e).alias("e_cm"),
                       h.alias("h_ref"), F.col("pos").cast("int").alias("pos"))


def request_batches(keys: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Distinct keys numbered in (n, e) order, cut into requests with their payload.

    Returns batch_no, n_points, payload (``"n e,n e,..."``, northing first).
    Each group holds at most ``batch_size`` rows.
    """
    from .numbering import sequential_index
    d = keys.select(*KEY).where(F.col("n_cm").isNotNull() & F.col("e_cm").isNotNull()).distinct()
    d = sequential_index(d, KEY, out="idx", start=0)
    d = d.withColumn("batch_no", F.floor(F.col("idx") / batch_size))
    txt = F.struct(F.col("idx"), F.concat(cm_text("n_cm"), F.lit(" "), cm_text("e_cm")).alias("t"))
    return (d.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_points"),
                                       F.sort_array(F.collect_list(txt)).alias("__l"))
            .select("batch_no", "n_points", F.concat_ws(",", F.col("__l.t")).alias("payload")))


def last_answer_wins(answers: DataFrame) -> DataFrame:
    """One height per key: the answer of the latest (pass, batch, position).

    Rows that stand for failed requests (``failed``) are no answers.
    """
    if "failed" in answers.columns:
        answers = answers.where(~F.col("failed"))
    return answers.groupBy(*KEY).agg(
        F.max_by("h_ref", F.struct("pass_no", "batch_no", "pos")).alias("h_ref"))


def all_zero_batches(answers: DataFrame) -> DataFrame:
    """Per (pass, batch): whether every returned height is 0.0."""
    if "failed" in answers.columns:
        answers = answers.where(~F.col("failed"))
    return answers.groupBy("pass_no", "batch_no").agg(F.bool_and(F.col("h_ref") == 0.0).alias("all_zero"))


# --- caller-supplied service -------------------------------------------------------

_NUMBER = re.compile(NUMERIC_TEXT)


def _number(token: str) -> float | None:
    """A token in plain decimal or exponent notation with a finite value."""
    value = float(token) if _NUMBER.match(token) else None
    return value if value is not None and math.isfinite(value) else None


def parse_answer(text: str) -> list[tuple[int, int, float]]:
    """Python twin of ``parse_response`` used inside tasks."""
    out = []
    for entry in (text or "").split(","):
        parts = entry.split()
        if len(parts) != 3:
            continue
        n, e, h = (_number(p) for p in parts)
        if n is not None and e is not None:
            out.append((round(n * 100), round(e * 100), 0.0 if h is None else h))
    return out


def fetch_with_retry(fetch: Callable[[list[tuple[float, float]]], str],
                     batch: list[tuple[float, float]], attempts: int = MAX_ATTEMPTS,
                     backoff: float = 0.0) -> list[tuple[int, int, float]]:
    """Up to ``attempts`` requests until an answer holds a height other than zero.

    A transport error (``OSError``, which covers connection and time-out
    errors, or ``HTTPException``), an empty or unreadable answer and one with
    zero heights only are all tried again; heights of the last attempt count
    even if all are zero.  Any other exception is an error in ``fetch`` and
    is raised.  An empty list: every attempt failed.
    """
    rows: list[tuple[int, int, float]] = []
    for attempt in range(1, attempts + 1):
        try:
            rows = parse_answer(fetch(batch))
        except (OSError, HTTPException):
            rows = []
        if any(h != 0.0 for _, _, h in rows):
            break
        if backoff and attempt < attempts:
            time.sleep(backoff * attempt)
    return rows


def _service_task(fetch, pass_no: int, batch_size: int, attempts: int, threads: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 32  # batch numbers differ between tasks

        def one(b):
            return fetch_with_retry(fetch, b, attempts)

        with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
            for pdf in it:  # one Arrow batch at a time: memory stays bounded
                keys = list(zip(pdf["n_cm"].tolist(), pdf["e_cm"].tolist()))
                parts = [keys[i:i + batch_size] for i in range(0, len(keys), batch_size)]
                answers = pool.map(one, [[(e / 100.0, n / 100.0) for n, e in p] for p in parts])
                for part, answer in zip(parts, answers):
                    rows = answer or [(n, e, None) for n, e in part]
                    n, e, h = zip(*rows)
                    yield pd.DataFrame({"n_cm": n, "e_cm": e, "h_ref": pd.Series(h, dtype="float64"),
                                        "pass_no": pass_no, "batch_no": base, "pos": range(len(rows)),
                                        "failed": not answer})
                    base += 1
    return run


def fetch_answers(keys: DataFrame, fetch: Callable[[list[tuple[float, float]]], str], *,
                  tasks: int = REQUEST_TASKS, batch_size: int = BATCH_SIZE,
                  attempts: int = MAX_ATTEMPTS, threads_per_task: int | None = None) -> DataFrame:
    """All answers of ``fetch`` for the distinct keys of ``keys``, both passes.

    ``fetch`` receives ``[(easting, northing), ...]`` in metres (at most
    ``batch_size`` points) and returns the service text.  ``tasks`` request
    streams run side by side, each with ``threads_per_task`` requests; by
    default ``MAX_REQUESTS`` in all.  Keys without an answer are asked again
    in a second pass.  Both passes are checkpointed, so every key is asked
    once per pass however often the result is used.  Keys of requests that
    failed to the end are rows with ``failed`` set and no height.
    """
    spark = keys.sparkSession
    from ..session import ship_package
    ship_package(spark)
    threads = threads_per_task or max(1, MAX_REQUESTS // tasks)
    d = keys.select(*KEY).where(F.col("n_cm").isNotNull() & F.col("e_cm").isNotNull()).distinct()

    def ask(rows: DataFrame, pass_no: int) -> DataFrame:
        # a numbered round-robin repartition is never coalesced by AQE
        return rows.repartition(tasks).mapInPandas(
            _service_task(fetch, pass_no, batch_size, attempts, threads), RESULT_SCHEMA).checkpoint()

    first = ask(d, 1)
    missing = d.join(first.where(~F.col("failed")).select(*KEY), KEY, "left_anti")
    return first.unionByName(ask(missing, 2))


def failed_keys(answers: DataFrame) -> DataFrame:
    """Keys whose requests failed in the last pass, with pass and batch."""
    found = answers.where(~F.col("failed")).select(*KEY)
    lost = answers.where(F.col("failed")).groupBy(*KEY).agg(
        F.max(F.struct("pass_no", "batch_no")).alias("b"))
    return lost.join(found, KEY, "left_anti").select(*KEY, "b.pass_no", "b.batch_no")


def fetch_heights(keys: DataFrame, fetch: Callable[[list[tuple[float, float]]], str],
                  **options) -> DataFrame:
    """Heights (n_cm, e_cm, h_ref) for the distinct keys of ``keys``; options of ``fetch_answers``."""
    return last_answer_wins(fetch_answers(keys, fetch, **options))
