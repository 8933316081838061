import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from levelling.llm import merkle, queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fan):
    """Root, and per leaf the siblings before and after on every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // fan * fan:p // fan * fan + fan]
            paths[i].append((run[:p % fan], run[p % fan + 1:]))
        at = [p // fan for p in at]
        nodes = [sha("".join(nodes[i:i + fan])) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def brute(rows, fan):
    """(doc_id, leaf, subroot, root, proof digest, folded root) of all rows."""
    groups = {}
    for i, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((i, leaf((i, source, lang, n, text)), (i, text, lang, source, n)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subs = {g: tree([x[1] for x in groups[g]], fan) for g in order}
    root, over = tree([subs[g][0] for g in order], fan)
    out = []
    for k, g in enumerate(order):
        for (i, own, (_, text, lang, source, n)), path in zip(groups[g], subs[g][1]):
            path = path + over[k]
            v = own
            if i is not None and zlib.crc32(str(i).encode()) % 7 == 0:
                v = leaf((i, source, lang, None if n is None else n + 1, text))
            for left, right in path:
                v = sha("".join([*left, v, *right]))
            out.append((i, own, subs[g][0], root, sha("".join(s for p in path for part in p for s in part)), v))
    return sorted(out, key=str)


def registered(spark, tmp, rows):
    spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit("clash")).withColumn("proof", F.lit(1)).coalesce(3) \
        .write.parquet(f"{tmp}/documents.parquet")
    got = queries.op12_merkle_manifest(spark, tmp).collect()
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got), key=str)


@pytest.mark.parametrize("sizes", [[1], [2], [1, 1], [3, 1, 1, 2, 1], [1500, 0, 17, 1, 64, 65]])
def test_query_matches_brute_force(spark, tmpdir_fresh, sizes):
    rows, langs = [], [None, "de", "Ä", "en", "z", "", "a"]
    for k, n in enumerate(sizes):
        rows += [(len(sizes) * i + k, None if i % 5 == 3 else "tëxt" * (i % 7), langs[k], None if i % 11 == 5 else "s:1",
                  None if i % 4 == 1 else i) for i in range(n)]
    if len(sizes) > 5:
        rows += [(None, "x", "en", "s", 1), (None, "y", "en", "s", 1), (None, None, None, None, None)]
        rows += [(7, "twice", "en", "s", 2)] * 5 + [(7, "other", "en", "s", 2)]
    got = registered(spark, f"{tmpdir_fresh}/t", rows)
    assert got == brute(rows, 2)
    tampered = [g for g in got if g[5] != g[3]]
    assert len(sizes) < 6 or len(tampered) > 100


def test_empty_table_and_long_text(spark, tmpdir_fresh):
    assert registered(spark, f"{tmpdir_fresh}/a", []) == []
    rows = [(1, "é" * 3000000, "en", "s", 1), (2, "", "en", "s", 1)]
    assert registered(spark, f"{tmpdir_fresh}/b", rows) == brute(rows, 2)


@pytest.mark.parametrize("fan", [3, 7, 256])
def test_other_fans(spark, fan, monkeypatch):
    monkeypatch.setattr(merkle, "TIER_NODES", 20)
    rows = [(i, "t", f"l{i % 11 if i < 60 else 0:02d}", "s", i) for i in range(700)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), FIELDS, "lang", "doc_id", fan=fan).collect()
    want = brute(rows, fan)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root) for r in got), key=str) == sorted((w[:4] for w in want), key=str)
    for r in got:
        assert merkle.fold(bytes.fromhex(r.leaf), bytes(r.proof)).hex() == r.root


def test_change_anywhere_in_a_proof_shows(spark):
    rows = [(i, "t", "en", "s", i) for i in range(40)]
    for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), FIELDS, "lang", "doc_id").limit(3).collect():
        proof = bytearray(r.proof)
        proof[5] ^= 1
        assert merkle.fold(bytes.fromhex(r.leaf), bytes(proof)).hex() != r.root
