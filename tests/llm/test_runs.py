import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelling.llm import periodic_runs as pr
from levelling.llm import queries
from tests.conftest import SF


def brute_lyndon(s):
    """Longest prefix of every suffix that is smaller than all its own proper suffixes."""
    out = []
    for i in range(len(s)):
        out.append(max(j for j in range(1, len(s) - i + 1)
                       if all(s[i:i + j] < s[i + k:i + j] for k in range(1, j))))
    return out


def brute_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)      # the smallest period comes first
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapse(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_grouping_gives_the_lyndon_array():
    rng = random.Random(3)
    for _ in range(400):
        parts = [[rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(1, 14))] for _ in range(3)]
        s = np.array([x for p in parts for x in [0, *p]])
        want = [x for p in parts for x in [0, *brute_lyndon(p)]]
        assert pr.lyndon(s).tolist() == want


@pytest.mark.parametrize("least", [1, 2, 5, 12])
def test_runs_match_brute_force(spark, least):
    rng = random.Random(least)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, "a " * 11), (5, "a " * 12), (6, "a A " * 9), (None, "b " * 30),
            (7, "x y " * 20), (8, "a\x0bb\x0ca b a b a b a b a b"), (7, "x y " * 20)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    rows += [(10, " ".join(fib[-1])), (11, " ".join("aabaab" * 7 + "b" + "aab" * 9))]
    for i in range(60):
        words = []
        while len(words) < rng.randint(0, 120):
            piece = [rng.choice("abcD"[:rng.randint(1, 4)]) for _ in range(rng.randint(1, 9))]
            words += piece * rng.choice([1, 1, 2, 5])
        rows.append((20 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash"))
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in
                  pr.find_runs(df, least=least).collect()), key=str)
    want = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        found = brute_runs(words, least)
        want.append((i, found, brute_collapse(words, found)))
    assert got == sorted(want, key=str)
    assert pr.find_runs(df.limit(0)).collect() == []


def test_long_texts_and_many_documents_in_a_block(spark):
    rng = random.Random(5)
    block = [str(rng.randint(0, 50)) for _ in range(20000)]
    rows = [(1, " ".join(block * 3)), (2, "x " * 100000), (3, " ".join(block) + " " + "y z " * 3000)]
    rows += [(10 + i, "common words that many documents hold once each, number " + str(i)) for i in range(2000)]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in
           pr.find_runs(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got[1] == [(0, 60000, 20000)] and got[2] == [(0, 100000, 1)] and got[3] == [(20000, 6000, 2)]
    assert not any(got[i] for i in got if i >= 10)


def test_registered_query_matches_brute_force(spark):
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for d in docs:
        words = [w.decode() for w in (d.text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found, r = brute_runs(words), got[d.doc_id]
        top = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        want = (len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None)
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapse(words, found).encode()).hexdigest()
    assert planted
