"""Exact top-k search by integer inner product (operator 1).

Vectors are turned into integers ``floor(scale * x)``.  Candidates are dealt
by hash into shards and queries into groups; every (group, shard) tile is one
dense matrix product in numpy with a partial selection of the k best per
query.  The tiles' lists are merged in a tree of fan-in ``FAN_IN``, so a task
never holds more than ``FAN_IN * k`` entries of a query.  Tile sizes follow
the row counts (more rows: larger tiles up to a fixed size); they change how
work is dealt, never the result.

Defined results: a null id or an unusable vector (null, or with null, NaN or
infinite components) takes no part, neither as query nor as candidate; every
row is a candidate of every other row, rows that repeat an id among them, and
each row where ``queries`` holds has a list of its own; only vectors of equal
length are compared (an empty vector has score 0 with empty ones);
components and scores beyond the 64-bit range saturate; an empty table gives
an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stash
from .vectors import matrix, usable

FAN_IN = 16
_MAX = (1 << 63) - 1
_TILE = "row long, query_id long, node long, top array<struct<neg:long,vec_id:long>>"


def _keys(q: np.ndarray, c: np.ndarray) -> np.ndarray | None:
    """Score * n + (n - 1 - column) as int64, or None where that could overflow."""
    n, d = len(c), max(1, q.shape[1])
    peak = max(int(np.abs(q).max(initial=0)), 1) * max(int(np.abs(c).max(initial=0)), 1) * d
    if q.min(initial=0) == -_MAX - 1 or c.min(initial=0) == -_MAX - 1 or peak >= (1 << 62) // n:
        return None
    kind = np.float32 if peak < 1 << 24 else np.float64 if peak < 1 << 53 else np.int64
    s = q.astype(kind) @ c.astype(kind).T
    if peak * n < 1 << 52:  # exact in double, which partitions faster than int64
        s = s.astype(np.float64)
    else:
        s = s.astype(np.int64)
    s *= n
    s += np.arange(n - 1, -1, -1, dtype=s.dtype)
    return s


def _tile_top(qrow: np.ndarray, q: np.ndarray, crow: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int,
              rows: int = 512, cols: int = 8192):
    """Per query row the k best (score, id) of the tile but its own row, ties to the smaller id."""
    order = np.argsort(cid, kind="stable")
    crow, cid, c = crow[order], cid[order], c[order]
    for lo in range(0, len(qrow), rows):
        ids, block = qrow[lo:lo + rows], q[lo:lo + rows]
        best: list[list[tuple[int, int]]] = [[] for _ in ids]
        for at in range(0, len(cid), cols):
            part, pid, prow = c[at:at + cols], cid[at:at + cols], crow[at:at + cols]
            n = len(pid)
            by_row = np.argsort(prow)
            own = by_row[np.minimum(np.searchsorted(prow, ids, sorter=by_row), n - 1)]
            mine = prow[own] == ids
            keys = _keys(block, part)
            if keys is None:
                for i, row in enumerate(block.astype(object) @ part.astype(object).T):
                    best[i] += [(max(-_MAX, min(_MAX, int(s))), int(p))
                                for s, p, r in zip(row, pid, prow) if r != ids[i]]
            else:
                hit = np.flatnonzero(mine)
                keys[hit, own[hit]] = np.finfo(float).min if keys.dtype.kind == "f" else -_MAX
                m = min(k + 1, n)
                pick = np.argpartition(keys, n - m, axis=1)[:, n - m:]
                for i in range(len(ids)):
                    val = keys[i, pick[i]]
                    if mine[i]:
                        val = val[pick[i] != own[i]]
                    v = val.astype(np.int64)
                    best[i] += zip((v // n).tolist(), pid[n - 1 - v % n].tolist())
            for i, b in enumerate(best):
                b.sort(key=lambda e: (-e[0], e[1]))
                del b[k:]
        yield ids, best


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0,
          id_col: str = "vec_id", vec_col: str = "embedding", max_shard: int = 65536,
          max_group: int = 16384) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every row where ``queries`` holds.

    ``queries`` is a condition on the table's columns; candidates are all
    other rows.  Fewer than k candidates give fewer rows.
    """
    vec = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    ready = stash(
        vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v"),
                F.coalesce(queries, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("row")),
        "vectors")
    n = ready.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    shard = min(max_shard, max(1024, -(-n["n"] // (4 * cores))))
    shards = max(1, -(-n["n"] // shard))
    groups = max(1, -(-n["q"] // max_group))

    def deal(salt, m):
        return F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(m))
    dim = F.size("v").alias("dim")
    cand = ready.select(dim, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"),
                        deal(1, shards).alias("s"), F.lit(False).alias("is_q"), "row", "vec_id", "v")
    quer = ready.where("q").select(dim, deal(2, groups).alias("g"),
                                   F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("s"),
                                   F.lit(True).alias("is_q"), "row", "vec_id", "v")

    def tile(key, t):
        is_q = t["is_q"].to_numpy()
        ids, rows = t["vec_id"].to_numpy(), t["row"].to_numpy()
        x = matrix(t["v"], np.int64)
        out = {"row": [], "query_id": [], "top": []}
        if is_q.any() and not is_q.all():
            name = dict(zip(rows[is_q].tolist(), ids[is_q].tolist()))
            for at, best in _tile_top(rows[is_q], x[is_q], rows[~is_q], ids[~is_q], x[~is_q], k):
                for i, b in zip(at.tolist(), best):
                    if b:
                        out["row"].append(i)
                        out["query_id"].append(name[i])
                        out["top"].append([{"neg": -s, "vec_id": v} for s, v in b])
        top = pa.list_(pa.struct([("neg", pa.int64()), ("vec_id", pa.int64())]))
        return pa.table({"row": pa.array(out["row"], pa.int64()),
                         "query_id": pa.array(out["query_id"], pa.int64()),
                         "node": pa.array([key[2].as_py()] * len(out["top"]), pa.int64()),
                         "top": pa.array(out["top"], top)})

    tops = cand.unionByName(quer).groupBy("dim", "g", "s").applyInArrow(tile, _TILE)
    while True:  # one pass per level of the merge tree; at least one orders the single list
        shards = -(-shards // FAN_IN)
        tops = (tops.groupBy("row", "query_id", F.floor(F.col("node") / FAN_IN).alias("node"))
                .agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")))
        if shards <= 1:
            break
    return tops.select("query_id", F.posexplode("top").alias("pos", "e")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("e.vec_id").alias("vec_id"), (-F.col("e.neg")).alias("score"))
