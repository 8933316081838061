"""Periodic runs of words and texts without their repeats (operator 13).

A run is a stretch of consecutive words with smallest period q, at least
``max(least, 2 q)`` words long, that no neighbouring word extends.  Each task
takes blocks of whole documents:

1. A run of that length repeats each of its words as part of an equal n-gram of
   ``ceil(least / 2)`` words at distance q.  Only stretches of words covered by
   n-grams that occur twice in their document can hold runs, and a run lies
   wholly within one stretch; the stretches of a block become one string of
   word numbers, a separator before each.
2. ``lyndon``: phase one of Baier's suffix sorter.  Suffixes are grouped by
   first word; groups are taken from the highest down, every member finds the
   nearest earlier suffix of a lower group, and these are moved to a new group
   right behind their old one, first by how many members point at them.  When a
   group is taken, the length of its common prefix is the longest Lyndon word
   at each member.  This runs once per order of the words (as numbered, and
   reversed; separators lowest in both).
3. Every run has a Lyndon root that is the longest Lyndon word of its place
   under one of the orders.  Each place and its Lyndon length are a candidate
   root, extended to both sides by longest common extensions: names of all
   blocks of 2^k words (equal names: equal words) are compared from the largest
   k down, for all candidates at once.

Words are compared by their bytes; hashes only choose the stretches, where a
collision makes a stretch longer and changes no result.  Work and memory of a
task are linear in its longest document, but for a logarithm in step 3.
Nothing is shuffled and nothing reaches the driver.

Defined results: null texts, empty texts and texts of blanks have no words and
no runs, their collapsed text is empty; the collapsed text has its words joined
by one blank also where there is no run; every input row gives one row, rows
that repeat an id included; a null id stays null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import Words, blocks, mix

_U = np.uint64
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon(s: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place of ``s``; 0 is a separator and must stand first."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(s[order]) != 0))
    width = np.diff(np.append(first, n))
    at, group = np.empty(n, np.int64), np.empty(n, np.int64)
    at[order] = np.arange(n)
    group[order] = np.repeat(first, width)
    place, at, group = order.tolist(), at.tolist(), group.tolist()   # suffixes in order, and back
    size, context = [0] * n, [1] * n                                  # by the first place of a group
    for g, w in zip(first.tolist(), width.tolist()):
        size[g] = w
    before, longest = [0] * n, [0] * n
    end, lowest = n, int(np.count_nonzero(s == 0))
    while end > lowest:
        g = group[place[end - 1]]
        members = place[g:end]
        members.sort()
        length, pointed = context[g], {}
        for i in members:
            longest[i] = length
            j = i - 1
            while group[j] >= g:
                j = before[j]
            before[i] = j
            pointed[j] = pointed.get(j, 0) + 1
        end = g
        parts: dict[tuple[int, int], list[int]] = {}
        for j, k in pointed.items():
            if group[j]:                                              # not a separator
                parts.setdefault((-k, group[j]), []).append(j)
        for (k, old), moved in sorted(parts.items()) if len(parts) > 1 else parts.items():
            held = size[old]
            new = old + held - len(moved)
            context[new] = context[old] - k * length
            if new == old:
                continue
            size[old], size[new] = held - len(moved), len(moved)
            t = old + held
            for j in moved:
                t -= 1
                other, p = place[t], at[j]
                place[p], at[other] = other, p
                place[t], at[j] = j, t
                group[j] = new
    return np.array(longest, np.int64)


def _names(s: np.ndarray, longest: int) -> list[np.ndarray]:
    """Per k the names of the blocks of 2^k symbols at all places where one fits."""
    levels = [s.astype(np.int64)]
    while 1 << len(levels) <= longest:
        half, low = 1 << (len(levels) - 1), levels[-1]
        pair = low[:-half] * (int(low.max()) + 1) + low[half:]
        levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
    return levels


def _forward(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common extension of the places a < b to the right."""
    got = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name = levels[k]
        y = b + got
        fits = np.flatnonzero(y < len(name))
        same = fits[name[a[fits] + got[fits]] == name[y[fits]]]
        got[same] += 1 << k
    return got


def _backward(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common extension to the left of the places just before a < b."""
    got = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name = levels[k]
        x = a - got - (1 << k)
        fits = np.flatnonzero(x >= 0)
        same = fits[name[x[fits]] == name[b[fits] - got[fits] - (1 << k)]]
        got[same] += 1 << k
    return got


def runs(s: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of a string of numbers, 0 before every stretch."""
    sep = np.flatnonzero(s == 0)
    top = int(s.max())
    single = s.copy()
    single[sep] = top + 1 + np.arange(len(sep))      # separators equal nothing
    levels = _names(single, int(np.diff(np.append(sep, len(s))).max()))
    found = []
    for symbols in (s, np.where(s == 0, 0, top + 1 - s)):
        period = lyndon(symbols)
        start = np.flatnonzero((s > 0) & (np.arange(len(s)) + period < len(s)))
        period = period[start]
        right = _forward(levels, start, start + period)
        left = _backward(levels, start, start + period)
        length = left + period + right
        keep = length >= np.maximum(least, 2 * period)
        found.append(np.stack([start - left, length, period], 1)[keep])
    return np.unique(np.concatenate(found), axis=0)


def stretches(w: Words, width: int) -> np.ndarray:
    """Rows (first, end) of the words covered by n-grams that occur twice in their document."""
    h, n = w.hashes(), len(w.start)
    if n <= width:
        return np.zeros((0, 2), np.int64)
    doc = np.repeat(np.arange(len(w.off) - 1), np.diff(w.off))
    roll = doc[:n - width + 1].astype(_U)
    for i in range(width):
        roll = mix(roll + h[i:n - width + 1 + i])
    at = np.flatnonzero(doc[:n - width + 1] == doc[width - 1:])
    order = at[np.argsort(roll[at], kind="stable")]
    same = roll[order[1:]] == roll[order[:-1]]
    twice = np.zeros(n + 1, np.int64)
    hit = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(twice, hit, 1)
    np.add.at(twice, hit + width, -1)
    covered = np.cumsum(twice[:n]) > 0
    border = np.append(True, (covered[1:] != covered[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(border)
    end = np.append(first[1:], n)
    keep = covered[first]
    return np.stack([first[keep], end[keep]], 1)


def _block(data: np.ndarray, off: np.ndarray, least: int) -> list[list[tuple[int, int, int]]]:
    """Runs of every document of a block, in words of the document."""
    w = Words(data, off)
    parts = stretches(w, (least + 1) // 2)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(off) - 1)]
    if not len(parts):
        return out
    size = parts[:, 1] - parts[:, 0]
    begin = np.cumsum(size + 1) - size                # of each stretch in the string
    s = np.zeros(int((size + 1).sum()), np.int64)
    inside = np.ones(len(s), bool)
    inside[begin - 1] = False
    which = np.repeat(parts[:, 0] - begin, size) + np.flatnonzero(inside)
    raw = data.tobytes()
    words = pa.array([raw[a:b] for a, b in zip(w.start[which].tolist(), w.end[which].tolist())], pa.binary())
    s[inside] = 1 + words.dictionary_encode().indices.to_numpy()
    got = runs(s, least)
    part = np.searchsorted(begin, got[:, 0], side="right") - 1
    first = got[:, 0] - begin[part] + parts[part, 0]
    doc = np.searchsorted(w.off, first, side="right") - 1
    for d, a, n, q in zip(doc.tolist(), (first - w.off[doc]).tolist(), got[:, 1].tolist(), got[:, 2].tolist()):
        out[d].append((a, n, q))
    return out


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for a, n, q in found:
        gone[a + q] += 1
        gone[a + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed`` of every row; runs ascend by start, then period."""

    def scan(batches):
        for b in batches:
            for lo, hi, data, off in blocks(b["text"]):
                found = [sorted(r, key=lambda x: (x[0], x[2])) for r in _block(data, off, least)]
                raw = data.tobytes()
                short = [collapse(raw[x:y].split(), f) for x, y, f in zip(off[:-1].tolist(), off[1:].tolist(), found)]
                flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 3)
                item = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)],
                                                  names=["start", "length", "period"])
                ends = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), item),
                     pa.array(short, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")
                       ).mapInArrow(scan, RUNS)


def repeated_tail(text: Column, words: Column, a: Column, p: Column) -> Column:
    """``text`` with its words from number ``a`` on replaced by repeats of the ``p`` words there."""
    rest = F.size(words) - a
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int")))
    return F.when(rest > 0, F.array_join(F.concat(F.slice(words, 1, a), F.slice(again, 1, rest)), " ")).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Count, longest run and digests of ``find_runs``: the columns of the registered query."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"], r["length"], r["period"])), "\n")
    return (found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").cast("binary"), 256)
        .alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
