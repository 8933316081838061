"""Plan checks over every registered query."""

from levelling.plans import catalog

SF = "/root/testdata/sf0.001"
PYTHON_ALLOWED = {"height_service", "grid_heights"}  # caller-supplied service runs in mapInPandas


def test_plans_have_no_nested_loops_and_no_stray_python(spark):
    bad = []
    for name, fn in catalog.queries().items():
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append((name, "nested loop"))
        python = any(t in plan for t in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas",
                                         "PythonMapInArrow"))
        if python and name not in PYTHON_ALLOWED:
            bad.append((name, "python"))
    assert bad == []


def test_scan_prunes_columns(spark):
    plan = catalog.queries()["compare_file"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_large_sides_are_joined_by_shuffles_on_the_cell(spark, monkeypatch):
    from levelling.operators import pairing
    from levelling.sources import fixtures as fx
    monkeypatch.setattr(pairing, "BROADCAST_COPY_BYTES", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = fx.inp(spark, SF).select("k", "x", "y")
        out = pairing.nearest_pair(p, fx.cmp(spark, SF), 15.0)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "hashpartitioning(__gx" in plan and "hashpartitioning(gx" in plan
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Broadcast" not in plan
