import random
import re

import pytest
from pyspark.sql import functions as F

from levelling.llm import license_scan as ls
from levelling.llm import queries
from tests.conftest import SF

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORDS.findall((t or "").translate(UP))


def base(t):
    w = words(t)
    return sorted((i, label) for label, p in ls.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(t, notices, least=0.85):
    """Places, and spans by comparing every template with every diagonal it shares three words with."""
    w, spans = words(t), []
    tpl = [(label, words(n)) for label, n in sorted(set((a, tuple(words(b))) for a, b in notices)) for n in [" ".join(n)]]
    for k, (label, m) in enumerate(tpl):
        votes = {}
        for i in range(len(w) - 2):
            for j in range(len(m) - 2):
                if w[i:i + 3] == m[j:j + 3]:
                    votes[i - j] = votes.get(i - j, 0) + 1
        isles = []
        for d in sorted(votes):
            if isles and d - isles[-1][1] <= max(1, len(m) // 10):
                isles[-1][1] = d
                isles[-1][2] += votes[d]
            else:
                isles.append([d, d, votes[d]])
        for d0, d1, v in isles:
            a, e = max(0, d0), min(len(w), d1 + len(m))
            x, y = " ".join(w[a:e]), " ".join(m)
            if v >= 0.25 * (len(m) - 2) and (s := 1 - distance(x, y) / max(len(x), len(y))) >= least:
                spans.append((a, e, k, label, s))
    best, reach, isle = [], -1, []
    for s in sorted(spans):
        if s[0] >= reach and isle:
            best.append(max(isle, key=lambda q: (q[4], -q[2])))
            isle = []
        isle.append(s)
        reach = max(reach, s[1])
    best += [max(isle, key=lambda q: (q[4], -q[2]))] if isle else []
    return base(t), sorted((a, e, label, round(s, 9)) for a, e, _, label, s in best)


def test_scan_matches_brute_force(spark):
    rng = random.Random(2)
    notices = ls.NOTICES
    rows = [(1, None), (2, ""), (3, " .,-\n"), (4, "CC-BY"), (4, "CC-BY"), (4, "other"), (None, "cc by cc by"), (5, "cc"),
            (6, "All rights reserved. all RIGHTS--reserved! all rights"), (7, "GNU General Public License " * 3),
            (8, "ÀLL rights reserved; the KK cc by cc byİ general public licens"), (9, "x" * 100000 + " cc by"),
            (10, "word " * 50000 + "general public license")]
    for i in range(60):
        w = [rng.choice(["of", "the", "license", "software", "and", "public"]) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(1, 3)):
            n = words(rng.choice(notices)[1])
            for _ in range(rng.randint(0, 1 + len(n) // 20)):
                at = rng.randrange(len(n))
                n[at:at + rng.randint(0, 1)] = [rng.choice(["x", "the", "any"])] * rng.randint(0, 2)
            w += n + [rng.choice(["end", "the"])] * rng.randint(0, 3)
        rows.append((20 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash")).withColumn(
        "mark", F.lit(1))
    got = sorted(((r.doc_id, r.n_words, [(p.start, p.label) for p in r.places],
                   [(s.first, s.end, s.label, round(s.similarity, 9)) for s in r.spans])
                  for r in ls.scan(df, ls.templates(spark)).collect()), key=str)
    want = sorted(((i, len(words(t)), *brute(t, notices)) for i, t in rows), key=str)
    assert got == want
    assert sum(len(r[3]) for r in got) > 40
    assert ls.scan(df.limit(0), ls.templates(spark)).collect() == []


@pytest.mark.parametrize("changed, found", [(0, True), (2, True), (14, False)])
def test_changed_notices(spark, changed, found):
    n = words(dict((a, t) for a, t in ls.NOTICES if len(t) > 200)["mit"])
    step = len(n) // (changed + 1)
    for k in range(changed):
        n[k * step + 3] = "somethingelse"
    df = spark.createDataFrame([(1, "before it " + " ".join(n) + " after it")], "doc_id long, text string")
    row = ls.report(ls.scan(df, ls.templates(spark))).first()
    assert (row.labels == "mit", row.base_labels, row.n_base) == (found, "", 0)
    assert row.score == 1.0 if not changed else (0.85 <= row.score < 1) == found


def test_large_template_tables_are_not_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"a{i} cc by b{i} released under the MIT license") for i in range(50)],
                               "doc_id long, text string")
    want = sorted(map(str, ls.scan(df, ls.templates(spark)).collect()))
    monkeypatch.setattr(ls, "BROADCAST_GRAMS", 1)
    assert sorted(map(str, ls.scan(df, ls.templates(spark)).collect())) == want


def test_registered_query_finds_all_places_and_is_native(spark):
    df = queries.op11_license_scan(spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
    got = {r.doc_id: r for r in df.collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    for d in docs:
        b, r = base(d.text), got[d.doc_id]
        assert (r.n_words, r.n_base) == (len(words(d.text)), len(b))
        assert (r.first_word, r.last_word) == ((b[0][0], b[-1][0]) if b else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in b}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
