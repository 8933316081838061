"""Packing documents into optimal length buckets (operator 2).

The global histogram of lengths, one cell per length that occurs (k different
lengths take at least k * k / 2 tokens, so the cells grow at most as the root
of the corpus), goes to the driver, where dynamic programming chooses the
bucket boundaries with the least padding; the cost of a bucket satisfies the
quadrangle inequality, so each layer is solved by divide and conquer.  Inside
a bucket the documents, in hash order, fill batches of
``max(1, budget // bucket length)`` rows.  Documents are numbered by range
partitions and their counts, so a bucket with most documents is spread over
many tasks.

Defined results: the length is the number of words plus one end token, so null
and empty texts have length 1; a document longer than the budget keeps its
whole length and is a batch of its own (as are all of a bucket that is longer
than the budget); repeated rows are packed each; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelling.operators.numbering import sequential_index

from .store import stash
from .tokens import n_words


def best_boundaries(length: np.ndarray, count: np.ndarray, total: np.ndarray, k: int) -> list[int]:
    """Upper bounds of at most k buckets with the least padding.

    ``length`` ascending cell maxima, ``count`` documents and ``total`` tokens
    of each cell.
    """
    n = len(length)
    if not n:
        return []
    c = np.concatenate([[0.0], np.cumsum(count, dtype=np.float64)])
    t = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)])
    top = np.asarray(length, np.float64)

    def waste(i, j):  # cells i..j-1 in one bucket
        return top[j - 1] * (c[j] - c[i]) - (t[j] - t[i])

    prev = np.append(0.0, [waste(0, j) for j in range(1, n + 1)])
    back = []
    for _ in range(1, min(k, n)):
        cur, arg = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        cur[0] = 0.0
        todo = [(1, n, 0, n)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            v = prev[i] + waste(i, mid)
            best = int(v.argmin())
            cur[mid], arg[mid] = v[best], i[best]
            todo += [(lo, mid - 1, a, i[best]), (mid + 1, hi, i[best], b)]
        back.append(arg)
        prev = cur
    ends, j = [], n
    for arg in reversed(back):
        ends.append(j)
        j = int(arg[j])
        if not j:
            break
    if j:
        ends.append(j)
    return [int(length[e - 1]) for e in reversed(ends)]


def pack(docs: DataFrame, buckets: int = 8, budget: int = 16384, id_col: str = "doc_id",
         text_col: str = "text", length: Column | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, bucket, bucket_len, batch_id, slot, padding``."""
    length = n_words(F.col(text_col)) + 1 if length is None else length
    docs = stash(docs.select(F.col(id_col).alias("doc_id"), length.cast("long").alias("n_tokens"),
                             F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")), "lengths")
    hist = docs.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("n_tokens")
    size, count = hist["n_tokens"].to_numpy(), hist["n"].to_numpy()
    total = size * count
    ends = best_boundaries(size, count, total, buckets)
    upper = np.searchsorted(size, ends, side="right")
    before = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], upper[:-1]])] if ends else [0]
    rows = [max(1, budget // e) for e in ends] or [1]
    held = np.diff(np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], upper])]) if ends else [0]
    first = np.concatenate([[0], np.cumsum(-(-np.array(held) // np.array(rows)))])

    def pick(values):  # of the document's bucket
        return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("bucket") + 1)
    bucket = sum([(F.col("n_tokens") > F.lit(e)).cast("int") for e in ends[:-1]], F.lit(0))
    placed = sequential_index(
        docs.withColumn("bucket", bucket).withColumn("tie", F.monotonically_increasing_id()),
        ["bucket", "h", "doc_id", "tie"], out="no", start=0)
    at = F.col("no") - pick(before)
    return (placed.withColumn("bucket_len", pick(ends or [1])).withColumn("rows", pick(rows))
            .select("doc_id", "n_tokens", "bucket", "bucket_len",
                    (pick(first) + F.floor(at / F.col("rows"))).alias("batch_id"),
                    (at % F.col("rows")).cast("int").alias("slot"),
                    (F.col("bucket_len") - F.col("n_tokens")).alias("padding")))
