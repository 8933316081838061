"""Merkle manifest of a table with an inclusion proof per row (operator 12).

Every row is hashed to a leaf.  Leaves of one group ascend by key; every
``fan`` consecutive nodes (the last run may be shorter, even a single node)
become the hash of their digests until one node is left, the group's subroot;
subroots in the order of their groups are hashed to the root in the same way.

* Leaves get their place by range partitions (``sequential_index``; equal rows
  are spread by a last sort column), so a group with most of the rows is no hot
  key.  ``_levels`` builds several levels per shuffle: a task group is the at
  most ``TIER_NODES`` (or ``fan``) nodes below one node, whatever the size of
  the tree.
* Proofs by pointer jumping: every node starts with a pointer to its parent and
  the segment of its siblings there.  A self-join of the pointer table joins
  each pointer with the pointer of the node it points to: the segment grows by
  that node's segment and the distance doubles, until all leaves point at the
  root.  A leaf's pointer meets nodes whose level is a multiple of the distance,
  so after each round only these and the nodes above the subroots are kept
  beside the leaves.  The rounds are the logarithm of the tree's height.
* A segment is binary, per level two counts (siblings before and after) and the
  raw digests from left to right; ``fold`` hashes a leaf up along its segment.

Every table of a round is written to the shared folder.  The driver sees the
largest group size, the number of groups and the root.

Defined results: null fields are hashed as ``-``; rows with a null key come
first, a null group is a group (the first); rows that repeat a key, also whole
rows, are leaves of their own in the order of their leaf digests; an empty table
gives an empty result; columns that are not named take no part and are not
returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelling.operators.numbering import sequential_index

from .store import stash

TIER_NODES = 1024   # a task group holds at most so many nodes
SPREAD = 4096       # equal rows are spread over so many places of the sort order
TOP = -1            # number of the tree over the subroots

_NODE = "tree long, level int, pos long, height int, digest binary, seg binary"


def field(value: Column) -> Column:
    """Text under the hash: byte count, colon, value; ``-`` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields."""
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def height(width: int, fan: int) -> int:
    """Levels above the leaves of a tree with ``width`` leaves."""
    n = 0
    while width > 1:
        width, n = -(-width // fan), n + 1
    return n


def _hash(digests: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join([d.hex().encode() for d in digests])).digest()


def _height(width: Column, fan: int) -> Column:
    """``height`` as a column: the powers of ``fan`` below the width."""
    powers = [fan ** k for k in range(63) if fan ** k < 1 << 62]
    return sum(((width > F.lit(p)).cast("int") for p in powers[1:]), (width > F.lit(1)).cast("int"))


def _levels(leaves: DataFrame, tallest: int, fan: int) -> DataFrame:
    """All nodes (``_NODE``) of trees given their leaves (tree, pos, height, digest); ``seg``: siblings, null at the top."""
    tier = max(t for t in range(1, 64) if t == 1 or fan ** t <= TIER_NODES)

    def climb(base: int):
        def run(table: pa.Table) -> pa.Table:
            rows = table.sort_by("pos").to_pydict()
            tree, top = rows["tree"][0], rows["height"][0]
            first, nodes = rows["pos"][0], rows["digest"]
            end = min(top, base + tier)
            out = []
            for level in range(base, end):
                above = []
                for i in range(0, len(nodes), fan):
                    run = nodes[i:i + fan]
                    above.append(_hash(run))
                    out += [(level, first + i + j, d, bytes((j, len(run) - 1 - j)) + b"".join(run[:j] + run[j + 1:]))
                            for j, d in enumerate(run)]
                first, nodes = first // fan, above
            out.append((end, first, nodes[0], None))     # the top of the tree, or a leaf of the next tier
            level, pos, digest, seg = zip(*out)
            return pa.table({"tree": pa.array([tree] * len(out), pa.int64()), "level": pa.array(level, pa.int32()),
                             "pos": pa.array(pos, pa.int64()), "height": pa.array([top] * len(out), pa.int32()),
                             "digest": pa.array(digest, pa.binary()), "seg": pa.array(seg, pa.binary())})
        return run

    done = []
    todo = leaves.select("tree", F.lit(0).alias("level"), "pos", "height", "digest",
                         F.lit(None).cast("binary").alias("seg"))
    for base in range(0, tallest, tier):
        done.append(todo.where(F.col("height") <= base))
        built = stash(todo.where(F.col("height") > base)
                      .groupBy("tree", F.floor(F.col("pos") / F.lit(fan ** tier)).alias("block"))
                      .applyInArrow(climb(base), _NODE), "tier")
        done.append(built.where("seg is not null"))
        todo = built.where("seg is null")
    for d in done:
        todo = todo.unionByName(d)
    return todo


def _jump(pointers: DataFrame, to: DataFrame) -> DataFrame:
    """Pointers extended by the pointers of the nodes they point to."""
    y = to.select(*[F.col(c).alias(f"y_{c}") for c in to.columns])
    seen = F.col("y_tree").isNotNull()
    return pointers.join(y, (F.col("to_tree") == F.col("y_tree")) & (F.col("to_level") == F.col("y_level"))
                         & (F.col("to_pos") == F.col("y_pos")), "left").select(
        "tree", "level", "pos",
        F.when(seen, F.concat("seg", "y_seg")).otherwise(F.col("seg")).alias("seg"),
        *[F.when(seen, F.col(f"y_{c}")).otherwise(F.col(c)).alias(c) for c in ("to_tree", "to_level", "to_pos")])


def manifest(rows: DataFrame, fields: Sequence[str], group: str, key: str, fan: int = 2,
             keep: Sequence[Column] = ()) -> DataFrame:
    """``key, leaf, subroot, root`` (hex) and ``proof`` (segment from leaf to root) of every row.

    ``keep`` adds columns computed from the row; they are carried along.
    """
    if not 2 <= fan <= 256:
        raise ValueError("fan must be from 2 to 256")
    held = rows.select(F.col(key).alias("__key"), F.col(group).alias("__group"),
                       F.unhex(leaf_of([F.col(c) for c in fields])).alias("__leaf"), *keep)
    extra = held.columns[3:]
    placed = stash(sequential_index(
        held.withColumn("__tie", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))),
        ["__group", "__key", "__leaf", "__tie"], out="__at", start=0).drop("__tie"), "leaves")
    groups = placed.groupBy(F.col("__group").alias("g")).agg(F.min("__at").alias("start"),
                                                             F.count(F.lit(1)).alias("width"))
    groups = stash(sequential_index(groups, ["g"], out="tree", start=0), "groups")
    bounds = groups.agg(F.max("width").alias("widest"), F.count(F.lit(1)).alias("n")).first()
    tall, over = height(bounds["widest"] or 0, fan), height(bounds["n"], fan)

    base = stash(placed.join(groups, F.col("__group").eqNullSafe(F.col("g"))).select(
        "tree", (F.col("__at") - F.col("start")).alias("pos"), _height(F.col("width"), fan).alias("height"),
        "__key", "__leaf", *extra), "base")
    nodes = _levels(base.select("tree", "pos", "height", F.col("__leaf").alias("digest")), tall, fan)
    tops = stash(nodes.where("seg is null").select("tree", F.col("digest").alias("subroot")), "subroots")
    crown = _levels(tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"),
                                F.lit(over).alias("height"), F.col("subroot").alias("digest")), over, fan)
    root = crown.where("seg is null").select("digest").first()

    # a pointer to the parent; the subroot of a tree is its leaf in the tree over the groups, a lone leaf with it
    last = F.col("level") + 1 >= F.col("height")
    above = [F.when(last, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("to_tree"),
             F.when(last, F.lit(0)).otherwise(F.col("level") + 1).alias("to_level"),
             F.when(last, F.col("tree")).otherwise(F.floor(F.col("pos") / F.lit(fan))).alias("to_pos")]
    link = nodes.where("seg is not null or height = 0").select(
        "tree", "level", "pos", F.coalesce("seg", F.lit(b"")).alias("seg"), *above)
    leaves = link.where("level = 0")
    others = link.where("level > 0").unionByName(crown.where("seg is not null").select(
        "tree", "level", "pos", "seg", F.col("tree").alias("to_tree"), (F.col("level") + 1).alias("to_level"),
        F.floor(F.col("pos") / F.lit(fan)).alias("to_pos")))
    distance = 1
    while distance < max(tall, 1) + over:
        others = stash(others, "inner")
        leaves = stash(_jump(leaves, others), "proofs")
        distance *= 2                                    # leaves now meet levels that it divides
        kept = others.where((F.col("tree") == TOP) | (F.col("level") % distance == 0))
        others = _jump(kept, others)
    own = leaves.select("tree", "pos", F.col("seg").alias("proof"))
    return base.join(own, ["tree", "pos"]).join(tops, "tree").select(
        F.col("__key").alias(key), F.lower(F.hex("__leaf")).alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"),
        F.lit(root["digest"].hex() if root else None).alias("root"), "proof", *extra)


def siblings(proof: bytes):
    """Per level the digests before and after."""
    at = 0
    while at < len(proof):
        left, right = proof[at], proof[at + 1]
        at += 2
        got = [proof[at + 32 * i:at + 32 * i + 32] for i in range(left + right)]
        at += 32 * (left + right)
        yield got[:left], got[left:]


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that ``leaf`` and the siblings of ``proof`` give."""
    for left, right in siblings(proof):
        leaf = _hash([*left, leaf, *right])
    return leaf


def proof_digest(proof: Column) -> Column:
    """Hex digest of all siblings of a proof, level by level."""
    @F.arrow_udf("string")
    def digest(col: pa.Array) -> pa.Array:
        return pa.array([_hash([d for pair in siblings(p) for part in pair for d in part]).hex()
                         for p in col.to_pylist()], pa.string())
    return digest(proof)


def folded(leaf: Column, proof: Column) -> Column:
    """Hex root computed from a hex leaf and a proof."""
    @F.arrow_udf("string")
    def up(leaves: pa.Array, proofs: pa.Array) -> pa.Array:
        return pa.array([fold(bytes.fromhex(x), p).hex() for x, p in zip(leaves.to_pylist(), proofs.to_pylist())],
                        pa.string())
    return up(leaf, proof)
