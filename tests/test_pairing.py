import math
import random

import pytest
from pyspark.sql import functions as F

from levelling.operators import pairing, tree
from levelling.operators.pairing import PairColumns, mutual_pairs, nearest_pair
from tests.conftest import SF


def brute(left, right, r):
    out = {}
    for k, x, y in left:
        best = None
        for rid, rx, ry in right:
            d = math.sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry))
            if (r == 0 or d <= r) and (best is None or (d, rid) < best):
                best = (d, rid)
        out[k] = best
    return out


def points(seed, n, spread, dup=0):
    rnd = random.Random(seed)
    pts = [(rnd.uniform(0, spread), rnd.uniform(0, spread)) for _ in range(n)]
    pts += [pts[0]] * dup  # a hot coordinate
    return pts


def run(spark, left, right, r, **kw):
    ldf = spark.createDataFrame([(i, x, y) for i, x, y in left], "k long, x double, y double")
    rdf = spark.createDataFrame([(rid, x, y) for rid, x, y in right], "id string, x double, y double")
    out = nearest_pair(ldf, rdf, r, names=PairColumns("cid", "cx", "cy", "d"), **kw).collect()
    return {row["k"]: (None if row["cid"] is None else (row["d"], row["cid"])) for row in out}


@pytest.fixture(params=["cells", "shuffled cells", "tree", "shuffled tree"])
def plan(request, monkeypatch):
    """Every plan, also where the data would call for another one."""
    if "shuffled" in request.param:
        monkeypatch.setattr(pairing, "BROADCAST_COPY_BYTES", 0)
        monkeypatch.setattr(tree, "BROADCAST_NODE_BYTES", 0)
    monkeypatch.setattr(pairing, "DENSE_CANDIDATES", 0 if "tree" in request.param else 1 << 30)
    monkeypatch.setattr(tree, "LEAF", 4)
    monkeypatch.setattr(tree, "FAN", 5)
    return request.param


@pytest.mark.parametrize("r", [5.0, 0.0, 2.0])
def test_nearest_matches_brute_force(spark, r, plan):
    left = [(i, x, y) for i, (x, y) in enumerate(points(1, 300, 60.0, dup=40))]
    right = [(f"c{i:04d}", x, y) for i, (x, y) in enumerate(points(2, 250, 60.0, dup=30))]
    # exact ties: two right points at the same distance from a left point
    left.append((10_000, 100.0, 100.0))
    right += [("tie_b", 103.0, 100.0), ("tie_a", 97.0, 100.0)]
    assert run(spark, left, right, r) == brute(left, right, r)


def brute_mutual(left, right, r):
    f, b = brute(left, right, r), brute(right, left, r)
    return {(k, v[1], v[0]) for k, v in f.items() if v and b[v[1]] and b[v[1]][1] == k}


@pytest.mark.parametrize("r", [4.0, 0.0])
def test_mutual_matches_brute_force(spark, r, plan):
    left = [(i, x, y) for i, (x, y) in enumerate(points(5, 200, 50.0, dup=20))]
    right = [(f"c{i:04d}", x, y) for i, (x, y) in enumerate(points(6, 180, 50.0, dup=20))]
    left += [(900, 200.0, 200.0), (901, 204.0, 200.0), (902, 202.0, 203.0)]
    right += [("m", 202.0, 200.0), ("n", 205.0, 200.0)]
    ldf = spark.createDataFrame(left, "k long, x double, y double")
    rdf = spark.createDataFrame(right, "cid string, x double, y double")
    got = mutual_pairs(ldf, rdf, r, left_key="k", right_key="cid").collect()
    assert {(g["k"], g["cid_r"], g["distance"]) for g in got} == brute_mutual(left, right, r)
    assert mutual_pairs(ldf, rdf.limit(0), r, left_key="k", right_key="cid").collect() == []


def test_far_clusters_meet_few_points(spark):
    rnd = random.Random(7)
    left = [(i, rnd.uniform(0, 500), rnd.uniform(0, 500)) for i in range(1500)]
    right = [(f"r{i:05d}", 1e6 + rnd.uniform(0, 500), rnd.uniform(0, 500)) for i in range(3000)]
    right += [("near", 250.0, 250.0)]
    for some in (right, right[:-1]):
        ldf = spark.createDataFrame(left, "k long, x double, y double")
        rdf = spark.createDataFrame(some, "id string, x double, y double")
        got = nearest_pair(ldf, rdf, 0.0, names=PairColumns("cid", "cx", "cy", "d"), seen="seen").collect()
        want = brute(left, some, 0.0)
        assert {g["k"]: (g["d"], g["cid"]) for g in got} == want
        assert max(g["seen"] for g in got) < 300


def test_rows_beyond_a_wide_side_meet_few_points(spark):
    """a row far off compares with points on the side that faces it, not with all along that side."""
    rnd = random.Random(9)
    left = [(i, 2e6 + rnd.uniform(0, 500), rnd.uniform(0, 500)) for i in range(40)]
    right = [(f"r{i:05d}", rnd.uniform(0, 500), rnd.uniform(0, 500)) for i in range(20_000)]
    right += [(f"s{i:05d}", x + 1e6, y) for i, (_, x, y) in enumerate(right)]
    ldf = spark.createDataFrame(left, "k long, x double, y double")
    rdf = spark.createDataFrame(right, "id string, x double, y double")
    got = nearest_pair(ldf, rdf, 0.0, names=PairColumns("cid", "cx", "cy", "d"), seen="seen").collect()
    assert {g["k"]: (g["d"], g["cid"]) for g in got} == brute(left, right, 0.0)
    assert max(g["seen"] for g in got) < 150


def test_many_equal_left_points(spark):
    rnd = random.Random(8)
    pts = [(rnd.uniform(0, 300), rnd.uniform(0, 300)) for _ in range(500)]
    rdf = spark.createDataFrame([(f"r{i}", x, y) for i, (x, y) in enumerate(pts)], "id string, x double, y double")
    ldf = spark.range(100_000).select(F.col("id").alias("k"), F.lit(150.0).alias("x"), F.lit(150.0).alias("y"))
    want = brute([(0, 150.0, 150.0)], [(f"r{i}", x, y) for i, (x, y) in enumerate(pts)], 0)[0]
    for r in (0.0, 40.0):
        out = nearest_pair(ldf, rdf, r, names=PairColumns("cid", "cx", "cy", "d"))
        assert [tuple(x) for x in out.groupBy("cid", "d").count().collect()] == [(want[1], want[0], 100_000)]


def test_extreme_coordinates(spark, plan):
    left = [(1, 1e300, 0.0), (2, -1e300, 5.0), (3, 0.0, 0.0), (4, 1e18, 1e18)]
    right = [("a", 1e300, 0.0), ("b", 0.0, 1.0), ("c", 1e18, 1e18), ("d", -1e18, 2.0)]
    got = run(spark, left, right, 10.0)
    assert got == {1: (0.0, "a"), 2: None, 3: (1.0, "b"), 4: (0.0, "c")}


def test_morton_order_keeps_neighbours_together(spark):
    df = spark.createDataFrame([(float(i % 8), float(i // 8)) for i in range(64)], "x double, y double")
    rows = tree.with_morton(df, "x", "y", (0.0, 0.0, 7.0, 7.0), "code").orderBy("code").collect()
    for i in range(0, 64, 16):  # sixteen consecutive points fill a quarter
        assert len({(r.x // 4, r.y // 4) for r in rows[i:i + 16]}) == 1
    assert len({r.code for r in rows}) == 64


def test_unmatched_rows_are_kept(spark):
    got = run(spark, [(1, 0.0, 0.0), (2, 50.0, 50.0), (3, None, 1.0)], [("a", 1.0, 0.0)], 2.0)
    assert got == {1: (1.0, "a"), 2: None, 3: None}


def test_empty_right(spark):
    ldf = spark.createDataFrame([(1, 0.0, 0.0)], "k long, x double, y double")
    rdf = spark.createDataFrame([], "id string, x double, y double")
    out = nearest_pair(ldf, rdf, 5.0).collect()
    assert len(out) == 1 and out[0]["id_porownania"] is None


def test_mutual_pairs(spark):
    left = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 10.0, 0.0)], "id string, x double, y double")
    right = spark.createDataFrame([("p", 0.9, 0.0), ("q", 10.5, 0.0)], "cid string, x double, y double")
    got = {(r["id"], r["cid_r"]) for r in mutual_pairs(left, right, 5.0, left_key="id", right_key="cid").collect()}
    assert got == {("b", "p"), ("c", "q")}


def test_plan_has_no_nested_loop(spark):
    ldf = spark.createDataFrame([(1, 0.0, 0.0)], "k long, x double, y double")
    rdf = spark.createDataFrame([("a", 1.0, 0.0)], "id string, x double, y double")
    df = nearest_pair(ldf, rdf, 5.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_candidates_are_not_aggregated(spark):
    from levelling.sources import fixtures as fx
    p = fx.inp(spark, SF).select("k", "x", "y")
    text = nearest_pair(p, fx.cmp(spark, SF), 15.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "NestedLoop" not in text


def test_small_left_copies_only_points_near_it(spark, plan):
    left = [(i, x, y) for i, (x, y) in enumerate(points(3, 60, 40.0, dup=20))]
    right = [(f"r{i:04d}", x, y) for i, (x, y) in enumerate(points(4, 400, 400.0, dup=30))]
    assert run(spark, left, right, 3.0) == brute(left, right, 3.0)
    assert run(spark, left, right, 0.0) == brute(left, right, 0.0)


def test_dense_cluster_in_a_sparse_field(spark):
    rnd = random.Random(12)
    right = [(f"r{i:05d}", 500 + rnd.uniform(0, 3), 500 + rnd.uniform(0, 3)) for i in range(600)]
    right += [(f"s{i:04d}", rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for i in range(200)]
    left = [(i, 500 + rnd.uniform(-2, 5), 500 + rnd.uniform(-2, 5)) for i in range(300)]
    left += [(1000 + i, rnd.uniform(0, 1000), rnd.uniform(0, 1000)) for i in range(100)]
    assert run(spark, left, right, 15.0) == brute(left, right, 15.0)


def test_input_points_of_large_keys(spark, tmp_path):
    """places of points are defined beyond the keys whose product fits a long, and the same below."""
    from levelling.sources import fixtures as fx
    keys = [0, 1, 7, 199998, 199999, -5, 9_999_999, 10_000_000, 10_000_001, -10_000_001, 24_000_000, 25_000_000, 54_000_000, 10**15]
    spark.createDataFrame([(k,) for k in keys] + [(None,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")

    def at(k, a, b):
        v = k * k * a + k * b
        return (abs(v) % 199999) * (1 if v >= 0 else -1) / 100.0
    got = {r.k: (r.x, r.y) for r in fx.inp(spark, str(tmp_path)).select("k", "x", "y").collect()}
    assert got.pop(None) == (None, None)
    assert got == {k: (5900000.0 + at(k, 7919, 104729), 7400000.0 + at(k, 15485, 611953)) for k in keys}
