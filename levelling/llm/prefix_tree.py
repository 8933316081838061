"""Conversations as prefix trees of tokens with position ids and attention intervals (operator 6).

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside role and
text every ``<|`` gets a backslash (``<\\|``, one more if there are some), and
a line feed or backslash in a role is escaped, so control strings cannot occur
and the texts can be recovered.  The two marks are single tokens outside the
vocabulary; the rest is encoded piece by piece with a byte-level BPE
vocabulary, so equal turns always give equal tokens.  A run of blanks or of
other characters is cut every ``_RUN`` characters before that, since the
pattern's matcher cannot take runs of millions.

Conversations that begin with the same turns share those turns' tokens.  Each
turn is named by the digest of its whole prefix; sorting conversations by
their path of digests is depth-first order, and a conversation emits only the
turns after its longest common prefix with the one before it.  The sort is a
range partitioning on (path, conversation), so neither a tree nor an often
repeated conversation has to fit one task; per partition only its first path
and its last stack go to the driver, which chains them.

The nodes table has one row per distinct turn of a tree: ``tree`` (offset of
its first token in the global depth-first sequence), ``start`` (offset in the
tree), ``input_ids``, ``position_ids`` (depth in tokens along the path),
``loss_start``/``loss_end`` (tokens under the loss mask: an assistant's text)
and ``attend``: the intervals of the tree's sequence, besides its own preceding
tokens, that the node's tokens attend to, which are exactly its ancestors.

Defined results: turns are ordered by (turn, role, text), nulls first, repeated
rows stay; null role or text counts as empty; rows with a null id form one
conversation; only the role ``assistant`` is under the loss mask; empty tables
give empty tables; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import stash

START, END = "<|im_start|>", "<|im_end|>"
# fixed value: the public splitting pattern of the byte-level vocabularies
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_DIGEST = 16
_RUN = 4096  # blanks, or other characters, that the splitting pattern meets in one go
_RUNS = re.compile(rf"\s{{1,{_RUN}}}|\S{{1,{_RUN}}}")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Vocabulary:
    """A byte-level BPE vocabulary shipped as the bytes of its rank file; marks follow the last rank."""

    def __init__(self, raw: bytes):
        self.raw, self.enc = raw, None

    def __getstate__(self):
        return {"raw": self.raw, "enc": None}

    def load(self) -> Vocabulary:
        if self.enc is None:
            import tiktoken
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in self.raw.splitlines() if x)}
            self.enc = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.start = max(ranks.values()) + 1
            self.end = self.start + 1
        return self

    def encode(self, text: str) -> list[int]:
        cut = [m.end() for m in _RUNS.finditer(text) if m.end() - m.start() == _RUN] if len(text) > _RUN else []
        return [i for a, b in zip([0, *cut], [*cut, len(text)]) for i in self.enc.encode_ordinary(text[a:b])]

    def turn(self, role: str, text: str) -> tuple[list[int], int, int]:
        """Token ids of one turn and the range of its text among them."""
        head = [self.start, *self.encode(escape_role(role) + "\n")]
        body = self.encode(escape(text))
        return [*head, *body, self.end, *self.enc.encode_ordinary("\n")], len(head), len(head) + len(body)

    def text(self, ids) -> str:
        """Formatted text of tokens."""
        out, run = [], []
        for i in ids:
            if i in (self.start, self.end):
                out += [self.enc.decode_bytes(run), (START if i == self.start else END).encode()]
                run = []
            else:
                run.append(i)
        return b"".join([*out, self.enc.decode_bytes(run)]).decode()


class Tree(NamedTuple):
    nodes: DataFrame
    conversations: DataFrame


_TURN = ("ck string, conv_id long, depth int, role string, input_ids array<int>, loss_start int, "
         "loss_end int, path binary, lens array<int>")
_PLACED = ("ck string, conv_id long, depth int, tree long, start long, position long, "
           "attend array<struct<start:long,end:long>>, starts array<long>, n_turns int")


def _shared(a: bytes, b: bytes) -> int:
    """Number of leading turns that two paths have in common."""
    n = min(len(a), len(b)) // _DIGEST
    lo, hi = 0, n
    while lo < hi:  # prefixes are chained, so equality is monotone
        mid = (lo + hi + 1) // 2
        at = slice((mid - 1) * _DIGEST, mid * _DIGEST)
        lo, hi = (mid, hi) if a[at] == b[at] else (lo, mid - 1)
    return lo


def _turns(conversations: DataFrame, vocabulary) -> DataFrame:
    """One row per turn with tokens; the last turn of a conversation also has its path and lengths."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("ck"),
        F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")

    def walk(batches):
        voc = vocabulary.value.load()
        last, key, path, lens, mark = None, None, bytearray(), [], b""
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["ck"] != key:
                    if last:
                        out.append(last | {"path": bytes(path), "lens": lens})
                    key, path, lens, mark, last = r["ck"], bytearray(), [], b"", None
                if last:
                    out.append(last)
                role, text = r["role"] or "", r["text"] or ""
                raw = role.encode()
                mark = hashlib.blake2b(mark + len(raw).to_bytes(8, "big") + raw + text.encode(),
                                       digest_size=_DIGEST).digest()
                ids, lo, hi = voc.turn(role, text)
                last = {"ck": key, "conv_id": r["conv_id"], "depth": len(lens), "role": role,
                        "input_ids": ids, "loss_start": lo if role == "assistant" else None,
                        "loss_end": hi if role == "assistant" else None}
                path += mark
                lens.append(len(ids))
            yield _batch(out, _TURN_TYPES)
        if last:
            yield _batch([last | {"path": bytes(path), "lens": lens}], _TURN_TYPES)

    return (rows.repartition("ck").sortWithinPartitions("ck", "turn", "role", "text")
            .mapInArrow(walk, _TURN))


_IDS = pa.list_(pa.int32())
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TURN_TYPES = {"ck": pa.string(), "conv_id": pa.int64(), "depth": pa.int32(), "role": pa.string(),
               "input_ids": _IDS, "loss_start": pa.int32(), "loss_end": pa.int32(), "path": pa.binary(),
               "lens": _IDS}
_PLACED_TYPES = {"ck": pa.string(), "conv_id": pa.int64(), "depth": pa.int32(), "tree": pa.int64(),
                 "start": pa.int64(), "position": pa.int64(), "attend": _SPANS,
                 "starts": pa.list_(pa.int64()), "n_turns": pa.int32()}


def _batch(rows: list[dict], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in types.items()],
                                      names=list(types))


class _Stack:
    """The path last emitted, with the global offset of each of its turns."""

    def __init__(self, path: bytes = b"", starts=(), at: int = 0):
        self.path, self.starts, self.at = path, list(starts), at

    def step(self, path: bytes, lens) -> int:
        """Move to the next conversation; the number of turns it shares."""
        k = _shared(self.path, path)
        del self.starts[k:]
        for n in lens[k:]:
            self.starts.append(self.at)
            self.at += n
        self.path = path
        return k


def build(conversations: DataFrame, tokenizer: str) -> Tree:
    """Nodes and conversations of ``conv_id, turn, role, text``.

    ``tokenizer`` is the path of a tiktoken rank file that the driver can read.
    """
    spark = conversations.sparkSession
    with open(tokenizer, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(Vocabulary(f.read()))
    turns = stash(_turns(conversations, vocabulary), "turns")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (turns.where("path is not null").select("ck", "conv_id", "path", "lens")
             .repartitionByRange(n, "path", "ck").sortWithinPartitions("path", "ck")
             .withColumn("p", F.spark_partition_id()).checkpoint())

    def ends(batches):
        """First path of the partition, and the stack after it as if nothing came before."""
        stack, first, lens, p = _Stack(), None, None, None
        for b in batches:
            for path, n_, p_ in zip(b["path"], b["lens"], b["p"]):
                path, n_ = path.as_py(), n_.as_py()
                if first is None:
                    first, lens, p = path, n_, p_.as_py()
                stack.step(path, n_)
        if first is not None:
            yield _batch([{"p": p, "first": first, "lens": lens, "last": stack.path,
                           "starts": stack.starts, "at": stack.at}],
                         {"p": pa.int32(), "first": pa.binary(), "lens": _IDS, "last": pa.binary(),
                          "starts": pa.list_(pa.int64()), "at": pa.int64()})

    summary = order.select("path", "lens", "p").mapInArrow(
        ends, "p int, first binary, lens array<int>, last binary, starts array<long>, at long").collect()
    begin, now = {}, _Stack()
    for r in sorted(summary, key=lambda r: r["p"]):
        begin[r["p"]] = (now.path, list(now.starts), now.at)
        k = _shared(now.path, bytes(r["first"]))
        saved = sum(r["lens"][:k])  # tokens that the partition alone would have emitted again
        # turns of the shared prefix were emitted before; all others move by a constant
        head = _shared(bytes(r["first"]), bytes(r["last"]))
        starts = [now.starts[i] if i < min(k, head) else now.at + s - saved for i, s in enumerate(r["starts"])]
        now = _Stack(bytes(r["last"]), starts, now.at + r["at"] - saved)
    begins = spark.sparkContext.broadcast(begin)

    def place(batches):
        stack = None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if stack is None:
                    stack = _Stack(*begins.value[r["p"]])
                k = stack.step(r["path"], r["lens"])
                starts, lens = stack.starts, r["lens"]
                tree = starts[0]
                spans, position = [], 0
                for d, (s, size) in enumerate(zip(starts, lens)):
                    s -= tree
                    if d >= k:
                        out.append({"ck": r["ck"], "conv_id": r["conv_id"], "depth": d, "tree": tree,
                                    "start": s, "position": position, "attend": [
                                        {"start": x, "end": y} for x, y in spans]})
                    if spans and spans[-1][1] == s:
                        spans[-1] = (spans[-1][0], s + size)
                    else:
                        spans.append((s, s + size))
                    position += size
                out.append({"ck": r["ck"], "conv_id": r["conv_id"], "tree": tree,
                            "starts": [s - tree for s in starts], "n_turns": len(starts),
                            "attend": [{"start": x, "end": y} for x, y in spans]})
                if len(out) >= 4096:
                    yield _batch(out, _PLACED_TYPES)
                    out = []
            yield _batch(out, _PLACED_TYPES)

    placed = stash(order.mapInArrow(place, _PLACED), "placed")
    nodes = stash(
        placed.where("depth is not null").join(
            turns.select("ck", "depth", "role", "input_ids", "loss_start", "loss_end"), ["ck", "depth"])
        .select("tree", "start", "depth", "role", "input_ids",
                F.transform("input_ids", lambda _, i: F.col("position") + i).alias("position_ids"),
                "loss_start", "loss_end", "attend"), "nodes")
    talks = stash(placed.where("depth is null")
                  .select("conv_id", "ck", "tree", "starts", "n_turns", F.col("attend").alias("spans")), "talks")
    return Tree(nodes, talks)


_READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
         "formatted_chars long")


def read_back(spark: SparkSession, tree: Tree, tokenizer: str) -> DataFrame:
    """Every conversation decoded from the nodes: counts and digests of its turns and its loss text."""
    with open(tokenizer, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(Vocabulary(f.read()))
    steps = (tree.conversations.select("ck", "conv_id", "tree", F.posexplode("starts").alias("depth", "start"))
             .join(tree.nodes.select("tree", "start", "input_ids", "loss_start", "loss_end"), ["tree", "start"])
             .select("ck", "conv_id", "depth", "input_ids", "loss_start", "loss_end")
             .repartition("ck").sortWithinPartitions("ck", "depth"))

    def decode(batches):
        voc = vocabulary.value.load()
        types = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(),
                 "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
        key, row, turns, loss = None, None, None, None

        def done():
            return row | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["ck"] != key:
                    if row:
                        out.append(done())
                    key, turns, loss = r["ck"], hashlib.sha256(), hashlib.sha256()
                    row = {"conv_id": r["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
                ids = r["input_ids"]
                text = voc.text(ids)
                if not (text.startswith(START) and text.endswith(END + "\n")):
                    raise ValueError(f"conversation {key}: a node is not one turn")
                role, _, body = text[len(START):-len(END) - 1].partition("\n")
                turns.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
                row["n_turns"] += 1
                row["formatted_chars"] += len(text)
                if r["loss_start"] is not None:
                    said = unescape(voc.text(ids[r["loss_start"]:r["loss_end"]]))
                    row["loss_chars"] += len(said)
                    loss.update(said.encode())
            yield _batch(out, types)
        if row:
            yield _batch([done()], types)

    return steps.mapInArrow(decode, _READ)
