"""N-gram Jaccard join with prefix filtering (operator 10).

A document is its set of hashed word n-grams.  All n-grams of the corpus are
counted into ``2**COUNTER_BITS`` hashed counters (a table of fixed size); an
n-gram's order key is its counter's logarithm and then its hash, so sorting
keys puts rare n-grams first by one total order for the whole corpus, and the
key is also the n-gram's identity.  Documents with equal sets form one class.

Candidate pairs share an n-gram of both prefixes (the first
``n - ceil(t n) + 1`` keys) and pass the length filter, the positional filter
(the keys from the shared one on still allow the overlap) and a suffix filter
(keys fall by hash into ``PARTS`` parts; the sum of the differences of the
parts' sizes bounds the symmetric difference from below, which is one flat
level of the recursive filter).  Each remaining pair is verified once on the
whole sets, recomputed from the text of the candidates alone.

Skew: a passage that very many documents share would make all pairs of them.
First every document is tried with one hub only: the document at the lowest
position of the prefix n-grams they share.  Verified links give components;
after that only pairs of different components can matter for the result, so
n-grams within one component drop out, and for the others pairs are formed
between the n-gram's largest component and the rest, and inside the rest.  The
joins are plain equi-joins on the n-gram, whose large partitions Spark splits.

Defined results: with fewer words than n the whole sequence is one n-gram; null
texts, empty texts and texts of blanks have an empty set and link with nothing;
so do rows with a null id (component_id null); rows that repeat an id are
documents of their own, one output row each: two texts of one id link like any
other two, and a link of one of them says nothing about the other; an empty table
gives an empty result; other columns are ignored by ``jaccard_components``, kept
by ``keep_one``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import stash
from .tokens import Words, blocks, mix

COUNTER_BITS = 20
COUNTER_ROWS = 16   # the counters travel in so many pieces
PARTS = 64
BUCKETS = 1 << 20   # id buckets of the filter before texts are shuffled for verification
_U = np.uint64
_LOW = _U((1 << 56) - 1)


def ngrams(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """56-bit hashes of all word n-grams of a block, and the ranges of its rows."""
    w = Words(data, off)
    h = w.hashes()
    size = np.diff(w.off)
    roll = np.zeros(max(0, len(h) - n + 1), _U)
    for i in range(n):
        roll = mix(roll + h[i:len(h) - n + 1 + i]) if len(roll) else roll
    doc = np.repeat(np.arange(len(size)), size)
    whole = doc[:len(roll)] == doc[n - 1:] if len(roll) else np.zeros(0, bool)
    out, owner = [roll[whole]], [doc[:len(roll)][whole]]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        seq = np.zeros(len(short), _U)
        for i in range(n - 1):
            has = size[short] > i
            seq[has] = mix(seq[has] + h[w.off[short[has]] + i])
        out.append(mix(seq + size[short].astype(_U)))
        owner.append(short)
    key, own = np.concatenate(out), np.concatenate(owner)
    if len(short):
        order = np.argsort(own, kind="stable")
        key, own = key[order], own[order]
    return key & _LOW, np.searchsorted(own, np.arange(len(size) + 1))


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> _U(56 - COUNTER_BITS)).astype(np.int64)


def count_table(docs: DataFrame, n: int, text_col: str) -> np.ndarray:
    """The order byte of every counter: a finely stepped logarithm of its count over all documents."""
    size = 1 << COUNTER_BITS
    step = size // COUNTER_ROWS

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for _, _, data, off in blocks(b[0]):
                total += np.bincount(_slot(ngrams(data, off, n)[0]), minlength=size)
        if total.any():
            yield pa.RecordBatch.from_pydict({
                "piece": pa.array(range(COUNTER_ROWS), pa.int32()),
                "held": pa.array([_pack(total[i * step:(i + 1) * step]) for i in range(COUNTER_ROWS)],
                                 pa.binary())})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, held in zip(b["piece"].to_pylist(), b["held"]):
                total[piece] = total.get(piece, 0) + _unpack(held.as_py(), step)
        for piece, held in total.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()),
                                              "held": pa.array([held.tobytes()], pa.binary())})

    schema = "piece int, held binary"
    pieces = (docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(count, schema)
              .repartition(COUNTER_ROWS, "piece").mapInArrow(add, schema).collect())
    table = np.zeros(size, np.int64)
    for r in pieces:
        table[r["piece"] * step:(r["piece"] + 1) * step] = np.frombuffer(r["held"], np.int64)
    return np.minimum(255, np.floor(6 * np.log2(1 + table))).astype(np.uint8)


def _pack(counts: np.ndarray) -> bytes:
    """Non-zero counts as positions and values when few, else all of them."""
    at = np.flatnonzero(counts)
    if 2 * len(at) < len(counts) and counts.max(initial=0) < 1 << 31:
        return b"s" + at.astype(np.int32).tobytes() + counts[at].astype(np.int32).tobytes()
    return b"d" + counts.tobytes()


def _unpack(raw: bytes, size: int) -> np.ndarray:
    if raw[:1] == b"d":
        return np.frombuffer(raw, np.int64, offset=1)
    pair = np.frombuffer(raw, np.int32, offset=1).reshape(2, -1)
    out = np.zeros(size, np.int64)
    out[pair[0]] = pair[1]
    return out


def key_sets(col: pa.Array, n: int, order: np.ndarray):
    """Per row the sorted distinct order keys of its n-grams (rare first)."""
    for _, _, data, off in blocks(col):
        grams, at = ngrams(data, off, n)
        keys = (order[_slot(grams)].astype(_U) << _U(56)) | grams
        for lo, hi in zip(at[:-1], at[1:]):
            k = np.sort(keys[lo:hi])
            if len(k) > 1:
                k = k[np.append(True, k[1:] != k[:-1])]
            yield k


def _digest(keys: np.ndarray) -> bytes:
    return hashlib.blake2b(keys.tobytes(), digest_size=16).digest()


_SETS = "doc_id long, mark long, n int, digest binary, prefix array<long>, parts array<smallint>"


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``doc_id, mark, n_shingles, component_id, node`` of every row; ``mark`` is the hash of its text.

    ``node`` numbers the components (null for rows that cannot link; two
    components may have an id in common, if that id repeats).  Two documents link when ``100 * intersection >= percent * union``.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = spark.sparkContext.broadcast(count_table(source, n, "text"))  # 2**COUNTER_BITS bytes
    least = -(-100 // (100 - percent)) - 1 if percent < 100 else 1 << 62  # below: only equal sets link

    def sets(batches):
        for b in batches:
            rows = {k: [] for k in ("n", "digest", "prefix", "parts")}
            for k in key_sets(b["text"], n, order.value):
                m = len(k)
                rows["n"].append(m)
                rows["digest"].append(_digest(k) if m else None)
                rows["prefix"].append(k[:m - -(-m * percent // 100) + 1].view(np.int64) if m >= least else None)
                rows["parts"].append(np.minimum(
                    np.bincount((k & _U(PARTS - 1)).astype(np.int64), minlength=PARTS), 32767)
                    .astype(np.int16) if m >= least else None)
            yield pa.RecordBatch.from_arrays([
                b["doc_id"], b["mark"], pa.array(rows["n"], pa.int32()), pa.array(rows["digest"], pa.binary()),
                pa.array(rows["prefix"], pa.list_(pa.int64())), pa.array(rows["parts"], pa.list_(pa.int16()))],
                names=["doc_id", "mark", "n", "digest", "prefix", "parts"])

    scanned = stash(source.select("doc_id", F.xxhash64("text").alias("mark"),
                                  F.col("text").cast("binary").alias("text"))
                    .mapInArrow(sets, _SETS), "sets")
    classes = stash(scanned.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min(F.struct("doc_id", "mark")).alias("rep"),
        F.min_by(F.struct("n", "prefix", "parts"), "doc_id").alias("s")).select(
        "digest", F.col("rep.doc_id").alias("rep"), F.col("rep.mark").alias("mark"),
        F.monotonically_increasing_id().alias("node"), "s.*"), "classes")
    posts = classes.where("prefix is not null").select("node", "n", F.posexplode("prefix").alias("pos", "gram"))
    shared = posts.groupBy("gram").count().where("count > 1").select("gram")
    posts = stash(posts.join(shared, "gram"), "posts")

    def need(na, nb):  # smallest overlap that links sets of these sizes
        return F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))

    def passes(na, pa_, nb, pb):
        """Length and positional filter."""
        room = 1 + F.least(na - pa_ - 1, nb - pb - 1)
        return (F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb)) & (room >= need(na, nb))

    def bucket(c: str):
        return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).alias("bucket")

    def verify(pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a < b) those that link; suffix filter, then whole sets."""
        c = classes.select("node", "n", "parts")
        pairs = (pairs.join(c.select(*[F.col(x).alias(f"{x}_a") for x in c.columns]), F.col("a") == F.col("node_a"))
                 .join(c.select(*[F.col(x).alias(f"{x}_b") for x in c.columns]), F.col("b") == F.col("node_b")))
        apart = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))),
                            F.lit(0), lambda s, x: s + x)
        pairs = stash(pairs.where(apart <= F.col("n_a") + F.col("n_b") - 2 * need(F.col("n_a"), F.col("n_b")))
                      .select("a", "b"), "pairs")
        wanted = stash(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
                       .distinct().join(classes.select("node", "rep", "mark", "digest"), "node"), "wanted")

        def whole(batches):
            for b in batches:
                want, node = b["digest"].to_pylist(), b["node"].to_pylist()
                out = {"node": [], "keys": []}
                for i, k in enumerate(key_sets(b["text"], n, order.value)):
                    if _digest(k) == want[i]:
                        out["node"].append(node[i])
                        out["keys"].append(k.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out["node"], pa.int64()),
                                                  pa.array(out["keys"], pa.binary())], names=["node", "keys"])

        # texts that nobody asks for are dropped before the shuffle: by id bucket, a table of at most BUCKETS rows
        near = wanted.select(bucket("rep")).distinct()
        asked = source.withColumn("bucket", bucket("doc_id")).join(F.broadcast(near), "bucket", "left_semi")
        full = stash(asked.join(wanted, (F.col("doc_id") == F.col("rep")) & (F.xxhash64("text") == F.col("mark")))
                     .select("node", "digest", F.col("text").cast("binary").alias("text"))
                     .mapInArrow(whole, "node long, keys binary"), "whole")

        def compare(batches):
            for b in batches:
                keep = []
                for x, y in zip(b["ka"], b["kb"]):
                    x, y = (np.frombuffer(v.as_buffer(), _U) for v in (x, y))
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    o = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * o >= percent * (len(x) + len(y) - o))
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return stash(pairs.select("a", "b")
                     .join(full.select(F.col("node").alias("a"), F.col("keys").alias("ka")), "a")
                     .join(full.select(F.col("node").alias("b"), F.col("keys").alias("kb")), "b")
                     .select("a", "b", "ka", "kb").mapInArrow(compare, "a long, b long").distinct(), "links")

    # one hub per document
    hubs = posts.groupBy("gram").agg(F.min(F.struct("pos", "node", "n")).alias("hub"))
    tries = (posts.join(hubs, "gram").where(F.col("node") != F.col("hub.node"))
             .where(passes(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos")))
             .groupBy("node", F.col("hub.node").alias("hub")).count()
             .groupBy("node").agg(F.max(F.struct("count", (-F.col("hub")).alias("neg"))).alias("best"))
             .select("node", (-F.col("best.neg")).alias("hub")))
    first = stash(tries.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
                  .distinct(), "tries")
    links = verify(first)
    comp = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # pairs of different components
    known = posts.join(comp, "node", "left").select(
        "gram", "node", "n", "pos", F.coalesce("component", "node").alias("comp"))
    mixed = (known.groupBy("gram", "comp").count().groupBy("gram")
             .agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("count", "comp")).alias("top"))
             .where("k > 1").select("gram", F.col("top.comp").alias("top")))
    known = stash(known.join(mixed, "gram"), "mixed")
    a, b = known.where("comp <> top").alias("a"), known.alias("b")
    cross = (a.join(b, F.col("a.gram") == F.col("b.gram"))
             .where((F.col("a.comp") != F.col("b.comp"))
                    & ((F.col("b.comp") == F.col("b.top")) | (F.col("a.node") < F.col("b.node")))
                    & passes(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos")))
             .select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
             .join(first, ["a", "b"], "left_anti"))
    links = links.unionByName(verify(stash(cross, "cross")))
    comp = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = stash(classes.select("digest", "rep", "node").join(comp, "node", "left").select(
        "digest", "rep", F.coalesce("component", "node").alias("node")), "placed")
    final = placed.join(placed.groupBy("node").agg(F.min("rep").alias("component_id")), "node").select(
        "digest", "node", "component_id")
    linked = scanned.where("digest is not null and doc_id is not null").join(final, "digest").select(
        "doc_id", "mark", F.col("n").cast("long").alias("n_shingles"), "component_id", "node")
    alone = scanned.where("digest is null or doc_id is null").select(
        "doc_id", "mark", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"),
        F.lit(None).cast("long").alias("node"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without the later members of every component: the smallest id stays.

    Of rows that repeat id and text one stays; different texts under one id are
    judged each, and of near copies under one id that with the smallest hash stays.
    """
    key, text = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = stash(jaccard_components(docs, **options), "found")
    best = found.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("best"))
    found = stash(found.join(best, "node", "left").withColumn("stays", F.coalesce(
        F.col("best") == F.struct("doc_id", "mark"), F.lit(True))), "judged")
    gone = found.where("not stays").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    mark = F.xxhash64(text)
    left = docs.join(gone, (F.col(key) == F.col("__id")) & (mark == F.col("__mark")), "left_anti")
    # rows that repeat id and text of a document that stays: one of them stays
    again = (found.where("stays and node is not null")
             .groupBy("doc_id", "mark").count().where("count > 1")
             .select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")))
    same = (F.col(key) == F.col("__id")) & (mark == F.col("__mark"))
    return left.join(again, same, "left_anti").unionByName(
        left.join(again, same, "left_semi").withColumn("__mark", mark)
        .dropDuplicates([key, "__mark"]).drop("__mark"))
