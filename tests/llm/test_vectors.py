import numpy as np
from pyspark.sql import functions as F

from levelling.llm import cover_tree
from levelling.llm.components import components
from levelling.llm.cover_tree import near_duplicates
from levelling.llm.exact_topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_topk(rows, k):
    """Sorted rows of the result: every row is a candidate of every other row."""
    ok = [(i, [int(np.floor(64.0 * float(np.float32(x)))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(q, c)), j) for b, (j, c) in enumerate(ok)
                       if a != b and len(c) == len(q))
            out += [(i, r + 1, j, -n) for r, (n, j) in enumerate(s[:k])]
    return sorted(out)


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 8).round(1).tolist()) for i in range(90)]
    rows += [(i, rows[3][1]) for i in range(100, 140)]                     # ties
    rows += [(200, None), (201, [None] * 8), (202, [float("nan")] * 8), (203, [float("inf")] + [0.0] * 7),
             (204, [1.0, 2.0]), (220, [1.0, 0.5]), (240, []), (241, []), (None, [1.0] * 8),
             (60, rows[60][1]), (60, [9.0] * 8)]                           # repeated ids
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("query_id", F.lit("x"))
    got = [tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, k=5, max_shard=16, max_group=3).collect()]
    assert sorted(got) == brute_topk(rows, 5)


def test_topk_keeps_every_vector_of_an_id(spark):
    rows = [(2, [1.0, 0.0], 0), (2, [9.0, 1.0], 0), (20, [1.0, 0.0], 0)]
    got = top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=5).collect()
    assert [tuple(r) for r in got] == [(20, 1, 2, 36864), (20, 2, 2, 4096)]


def test_topk_huge_components_and_empty_table(spark):
    rows = [(0, [3e18, 1.0], 0), (1, [-3e18, 1.0], 0), (2, [2.0, 2.0], 0), (20, [1e30, 0.0], 0)]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in
           top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=3).collect()}
    big = (1 << 63) - 1
    assert [got[0, r] for r in (1, 2, 3)] == [(2, big), (20, big), (1, -big)]  # a tie: smaller id first
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []


def brute_links(rows, cos):
    """rows: (id, vector); counts and components by comparing everything."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
          and i is not None for i, v in rows]
    n = len(rows)
    lab, links = list(range(n)), [0] * n
    u = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v), o in zip(rows, ok)]

    def find(x):
        while lab[x] != x:
            x = lab[x]
        return x
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and len(u[a]) == len(u[b]) and float(u[a] @ u[b]) >= cos:
                links[a] += 1
                links[b] += 1
                lab[find(a)] = find(b)
    least = {}
    for a in range(n):
        if rows[a][0] is not None:
            least[find(a)] = min(least.get(find(a), rows[a][0]), rows[a][0])
    return sorted(((rows[a][0], links[a], least.get(find(a)) if rows[a][0] is not None else None)
                   for a in range(n)), key=str)


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 1, (12, 6))
    rows = []
    for i in range(260):
        c = centre[0] if i % 3 == 0 else centre[i % 12]                    # a third in one cluster
        rows.append((i, (c + rng.normal(0, rng.choice([0.02, 0.15, 0.4]), 6)).astype(np.float32).tolist()))
    rows += [(300 + i, rows[7][1]) for i in range(30)]                     # copies
    rows += [(400, None), (401, [0.0] * 6), (402, [float("nan")] * 6), (403, [None] * 6), (404, []),
             (405, [1.0, 0.0]), (406, [2.0, 0.0]), (None, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("n_links", F.lit(5))
    got = near_duplicates(df, 0.95, max_part=40).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_links(rows, 0.95)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_near_duplicates_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(60)]
    edges += [(7, 7), (5, 4), (500, 400), (300, 400), (400, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 300: 300, 400: 300, 500: 300}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_radii_cover_light_jitter():
    rng = np.random.default_rng(11)
    for step in (2e-4, 5e-4, 1e-3):
        base, move = rng.normal(size=(2, 300, 64))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        moved = base + step * move / np.linalg.norm(move, axis=1, keepdims=True)
        exact = np.stack([base, moved / np.linalg.norm(moved, axis=1, keepdims=True)], axis=1).reshape(600, 64)
        tree = cover_tree.Tree(np.arange(600), np.ones(600, np.int64), exact, (np.arange(600) // 2 * 2)[None, :])
        radius = tree.levels[0][2]
        assert np.all(np.abs(radius - np.linalg.norm(exact[::2] - exact[1::2], axis=1)) < 1e-6)


def test_vectors_that_share_an_id_stay_apart(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [0.0, 1.0]), (4, [0.01, 1.0]), (2, [-1.0, 0.0]), (9, [0.0, -1.0]),
            (2, [0.0, 2.0]), (4, [0.01, 1.0])]
    got = near_duplicates(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), 0.95).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute_links(rows, 0.95)
