"""Bad files, repeated and missing keys, failing requests, empty outputs."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from levelling.cli import _args
from levelling.operators.axes import roles_per_file
from levelling.operators.lookup import (failed_keys, fetch_answers, fetch_with_retry, join_heights,
                                        last_answer_wins, parse_answer, parse_response)
from levelling.operators.pairing import PairColumns, nearest_pair
from levelling.plans.pipelines import compare
from levelling.sinks.writers import (input_metrics, plain_text, qa_outputs, spatial_layer, split_layer, write_csv,
                                     write_layer)
from levelling.sources.delimited import BadFileError, parse_points, read_lines, read_points, read_scope, split_bad
from levelling.sources.workbook import CELL_SEP


def write(folder, name, *lines):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


# --- files ---------------------------------------------------------------------------------

def test_files_without_a_layout_are_named(spark, tmpdir_fresh):
    good = write(tmpdir_fresh, "good.csv", "a;1;2;3", "b;4;5;6")
    one = write(tmpdir_fresh, "one.csv", "alpha", "beta")
    empty = write(tmpdir_fresh, "empty.csv")
    with pytest.raises(BadFileError, match="one.csv"):
        read_points(spark, one)
    with pytest.raises(BadFileError, match="one.csv"):
        read_points(spark, [good, one])
    with pytest.raises(BadFileError, match="empty.csv"):
        read_points(spark, [good, empty])
    assert read_points(spark, [good, one], on_bad="drop").count() == 2
    scope = write(tmpdir_fresh, "scope.csv", "1;2;3;4", "5;6;7;8")
    with pytest.raises(BadFileError, match="scope.csv"):
        read_scope(spark, scope)


def test_wide_files_of_large_keys(spark, tmpdir_fresh):
    """the places overflowed a long from key 24 million on, so the files could not be written."""
    from levelling.plans.catalog_rows import scan_wide_files_q
    keys = [0, 1, 7, 199998, 9_999_999, 10_000_001, 24_000_001, 25_000_000, 53_999_998, 53_999_999]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmpdir_fresh}/orders.parquet")
    got = {r.id: (r.x, r.y, r.h) for r in scan_wide_files_q(spark, tmpdir_fresh).collect()}

    def place(base, k, a, b):
        return float(base) + (k * k * a + k * b) % 199999 / 100
    assert len(got) == len(keys)
    for k in keys:
        want = (place(5900000, k, 7919, 104729), place(7400000, k, 15485, 611953), 100.0 + k * 31 % 5000 / 100)
        assert got[f"P_{k}"] == pytest.approx(want, abs=1e-6), k


def test_wide_files_test_their_last_column_for_a_header(spark, tmpdir_fresh):
    body = ["P1;10;20;30" + ";" * 66 + ";7", "P2;11;21;31" + ";" * 66 + ";8"]
    head = "id;x;y;h" + ";" * 66 + ";note"
    wide = write(tmpdir_fresh, "wide.csv", head, *body)
    got = [(r.row_no, r.id, r.x) for r in read_points(spark, wide).orderBy("row_no").collect()]
    assert got == [(1, "P1", 10.0), (2, "P2", 11.0)]
    scope = write(tmpdir_fresh, "s.csv", "1;2" + ";" * 80 + "9;9", "3;4" + ";" * 80 + "9;9")
    with pytest.raises(BadFileError, match="s.csv"):
        read_scope(spark, scope)  # four columns hold values


def test_rows_are_numbered_over_splits(spark, tmpdir_fresh):
    n = 5000
    path = write(tmpdir_fresh, "big.csv", "x y h", *["" if i % 7 == 0 else f"{i} {2 * i} {3 * i}" for i in range(n)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = read_lines(spark, path)
        assert lines.select("file_split").distinct().count() > 5
        assert [r[0] for r in lines.orderBy("line_no").select("line_no").collect()] == list(range(1, n + 2))
        pts = read_points(spark, path)
        plan = pts._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
        got = [(r.row_no, r.id, r.x) for r in pts.orderBy("row_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    kept = [i for i in range(n) if i % 7]
    assert got == [(k + 1, f"P_{k + 1}", float(i)) for k, i in enumerate(kept)]


def test_quarantine_splits_off_bad_rows(spark):
    rows = [("f", 1, "a;1;2;3"), ("f", 2, "b;x;2;3"), ("f", 3, "c;4;5;6")]
    lines = spark.createDataFrame(rows, "source_file string, line_no long, value string")
    good = parse_points(lines, on_bad="quarantine")
    assert [(r.row_no, r.id) for r in good.orderBy("row_no").collect()] == [(1, "a"), (3, "c")]
    _, bad = split_bad(parse_points(lines, on_bad="keep"))
    assert [(r.row_no, r.id, r.x) for r in bad.collect()] == [(2, "b", None)]
    with pytest.raises(BadFileError):
        parse_points(lines)


def test_workbook_cells_keep_their_quotes(spark):
    rows = [("w", i, CELL_SEP.join(v)) for i, v in enumerate([('5" pipe', "1", "2", "3"), ('a', "4", "5", "6")], 1)]
    lines = spark.createDataFrame(rows, "source_file string, line_no long, value string")
    got = parse_points(lines, sep=CELL_SEP).orderBy("row_no").collect()
    assert [(r.id, r.x, r.h) for r in got] == [('5" pipe', 1.0, 3.0), ("a", 4.0, 6.0)]


# --- keys ----------------------------------------------------------------------------------

POINTS = "source_file string, row_no long, id string, x double, y double, h double"


def test_files_with_colliding_numbers_keep_their_own_pairs(spark):
    pts = spark.createDataFrame([("a", 1, "p", 0.0, 0.0, 1.0), ("b", 1, "q", 200.0, 200.0, 2.0)], POINTS)
    ref = spark.createDataFrame([("r", 1, "r", 0.5, 0.0, 1.5)], POINTS)
    got = {r.id_odniesienia: (r.id_porownania, r.odleglosc_pary) for r in
           compare(pts, key=["source_file", "row_no"], reference=ref).collect()}
    assert got == {"p": ("r", 0.5), "q": (None, None)}
    again = compare(pts, key="row_no", reference=ref).collect()   # keys that repeat change nothing
    assert {r.id_odniesienia: (r.id_porownania, r.odleglosc_pary) for r in again} == got


def test_unlimited_search_ends_with_missing_coordinates_and_outliers(spark):
    rows = [("a", i, f"p{i}", float(i), float(i % 7), 0.0) for i in range(300)]
    rows += [("a", 1000, "null", None, 1.0, 0.0), ("a", 1001, "nan", float("nan"), 1.0, 0.0),
             ("a", 1002, "inf", float("inf"), 1.0, 0.0), ("a", 1003, "far", 9e7, -9e7, 0.0)]
    pts = spark.createDataFrame(rows, POINTS)
    ref = spark.createDataFrame([("r", i, f"r{i}", i + 0.25, float(i % 7), 0.0) for i in range(300)]
                                + [("r", 999, "none", None, 0.0, 0.0)], POINTS)
    out = nearest_pair(pts, ref, 0.0, names=PairColumns("rid", "rx", "ry", "d"))
    got = {r.id: r.rid for r in out.collect()}
    assert len(got) == len(rows) and got["null"] is got["nan"] is got["inf"] is None
    far = min(range(300), key=lambda i: ((i + 0.25 - 9e7) ** 2 + (i % 7 + 9e7) ** 2, f"r{i}"))
    assert got["far"] == f"r{far}" and all(got[f"p{i}"] == f"r{i}" for i in range(300))
    limited = nearest_pair(pts, ref, 1.0, names=PairColumns("rid", "rx", "ry", "d"))
    assert {r.id: r.rid for r in limited.collect()} == {**got, "far": None}


def test_axis_order_is_decided_per_file(spark):
    rows = [("a", 1, "p", 5900000.0, 7400000.0, 0.0), ("a", 2, "p", 1.0, 2.0, 0.0),
            ("b", 1, "q", 7400000.0, 4900000.0, 0.0), ("b", 2, "q", 3.0, 4.0, 0.0)]
    got = roles_per_file(spark.createDataFrame(rows, POINTS), "source_file", ["source_file", "row_no"])
    assert {(r.source_file, r.row_no): (r.geodetic_northing, r.geodetic_easting) for r in got.collect()} == {
        ("a", 1): (5900000.0, 7400000.0), ("a", 2): (1.0, 2.0),
        ("b", 1): (4900000.0, 7400000.0), ("b", 2): (4.0, 3.0)}


# --- heights -------------------------------------------------------------------------------

def test_repeated_height_keys_do_not_multiply_points(spark):
    pts = spark.createDataFrame([(1, 2)], "n_cm long, e_cm long")
    h = spark.createDataFrame([(1, 2, 5.0, 1), (1, 2, 4.0, 2)], "n_cm long, e_cm long, h_ref double, seq int")
    assert [r.h_ref for r in join_heights(pts, h, order="seq").collect()] == [4.0]
    assert [r.h_ref for r in join_heights(pts, h).collect()] == [5.0]


def test_answers_with_white_space_type_letters_and_infinities(spark):
    text = "\n1.00 2.00 1d,\t3.00\t4.00\n7.5 ,inf 1 2,1e999 5 6,NaN 1 1,5 6 nan"
    want = [(100, 200, 0.0), (300, 400, 7.5), (500, 600, 0.0)]
    assert parse_answer(text) == want and parse_answer(None) == []
    df = spark.createDataFrame([(text,)], "response string")
    got = [(r.n_cm, r.e_cm, r.h_ref) for r in parse_response(df).orderBy("pos").collect()]
    assert [g for g in got if g[0] is not None and g[1] is not None] == want


def test_unreadable_answers_are_retried_and_program_errors_raised():
    answers = ["<html>busy</html>", "1.00 2.00 3.5"]
    assert fetch_with_retry(lambda pts: answers.pop(0), [(2.0, 1.0)]) == [(100, 200, 3.5)]

    def broken(pts):
        raise KeyError("no such field")
    with pytest.raises(KeyError):
        fetch_with_retry(broken, [(2.0, 1.0)])


def test_every_key_is_asked_once_per_pass_and_failures_are_rows(spark, tmpdir_fresh):
    def service(pts):
        for e, _ in pts:
            with open(os.path.join(tmpdir_fresh, f"{round(e * 100)}"), "a") as f:
                f.write(".")
        if any(round(e * 100) >= 900 for e, _ in pts):
            raise TimeoutError
        return ",".join(f"{n:.2f} {e:.2f} 1.5" for e, n in pts if round(e * 100) % 10)

    keys = spark.range(0, 1000).select(F.col("id").alias("n_cm"), F.col("id").alias("e_cm"))
    answers = fetch_answers(keys, service, tasks=3, batch_size=10, attempts=1, threads_per_task=2)
    heights = last_answer_wins(answers)
    assert heights.count() == heights.count()  # a second action asks for nothing
    asked = {p: len(open(os.path.join(tmpdir_fresh, p)).read()) for p in os.listdir(tmpdir_fresh)}
    assert len(asked) == 1000 and set(asked.values()) <= {1, 2}
    assert answers.where("batch_no is not null").select("pass_no", "batch_no").distinct().count() >= 100
    per = answers.groupBy("pass_no", "batch_no").count().where("count > 10").count()
    assert per == 0  # batch numbers are not shared between tasks
    lost = failed_keys(answers)
    assert lost.count() > 0 and lost.join(heights, ["n_cm", "e_cm"]).count() == 0
    m = input_metrics(answers=answers).first()
    assert m.n_retried >= 100 and m.n_loaded is None


# --- outputs -------------------------------------------------------------------------------

def test_numbers_are_written_without_exponent(spark, tmpdir_fresh):
    values = [0.0005, -0.00001, 12345678.5, 7400000.25, 0.0, 12.0, 1e20, None, 100.1, -0.125]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double")
    got = [r.v for r in df.orderBy("k").select(plain_text("v").alias("v")).collect()]
    assert got == ["0.0005", "-0.00001", "12345678.5", "7400000.25", "0.0", "12.0",
                   "100000000000000000000.0", None, "100.1", "-0.125"]
    write_csv(df, f"{tmpdir_fresh}/a")
    text = "".join(open(p).read() for p in glob.glob(f"{tmpdir_fresh}/a/*.csv"))
    assert "0.0005" in text and "brak_danych" in text and "E" not in text


def test_nothing_is_written_for_empty_results_and_unknown_zones(spark, tmpdir_fresh):
    pts = spark.createDataFrame([("a", 1, "p", 1.0, 2.0, 1.0)], POINTS)
    res = compare(pts, key=["source_file", "row_no"], reference=pts)
    write_csv(res.limit(0), f"{tmpdir_fresh}/empty")
    assert not os.path.exists(f"{tmpdir_fresh}/empty")
    layer = spatial_layer(res, pts, ["source_file", "row_no"])
    assert "eksport" not in layer.columns and "eksport" in split_layer(layer).columns
    write_layer(layer, f"{tmpdir_fresh}/layer")
    assert glob.glob(f"{tmpdir_fresh}/*") == []
    zoned = spark.createDataFrame([("a", 1, "p", 5900000.0, 7400000.0, 1.0)], POINTS)
    res = compare(zoned, key=["source_file", "row_no"], reference=zoned)
    write_layer(spatial_layer(res, zoned, ["source_file", "row_no"]), f"{tmpdir_fresh}/layer")
    assert "eksport" not in spark.read.parquet(f"{tmpdir_fresh}/layer").columns
    assert spark.read.parquet(f"{tmpdir_fresh}/layer_split").select("eksport").first()[0] is True


def test_grid_centres_are_named_in_order(spark):
    centres = spark.createDataFrame([(1, 5.0, 6.0), (2, 7.0, 8.0)], "seq_no long, x double, y double")
    p = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0, 5, 6)],
                              "id string, x double, y double, e_1992 double, n_1992 double, n_cm long, e_cm long")
    h = spark.createDataFrame([], "n_cm long, e_cm long, h_ref double")
    out = qa_outputs(p, h, centres)
    assert [tuple(r) for r in out["grid_centres"].orderBy("id").collect()] == [("s_1", 5.0, 6.0), ("s_2", 7.0, 8.0)]
    assert out["without_height"].count() == 1


def test_command_line_numbers_and_swaps():
    a = _args(["--mode", "1", "--out", "o", "--max-distance", "12,5", "--swap-reference"])
    assert a.max_distance == 12.5 and (a.swap_points, a.swap_reference, a.swap_scope) == (False, True, False)
    assert _args(["--mode", "1", "--out", "o", "--swap-xy"]).swap_scope
    for bad in ("nan", "inf", "x"):
        with pytest.raises(SystemExit):
            _args(["--mode", "1", "--out", "o", "--tolerance", bad])
