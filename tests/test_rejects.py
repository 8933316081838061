from levelling.sources.delimited import parse_points
from levelling.sources.rejects import reject_lines

LINES = "source_file string, line_no long, value string"


def test_every_line_is_a_good_row_or_has_a_reason(spark):
    rows = [("a", 1, "nr;x;y;h"), ("a", 2, "1;5;6;7"), ("a", 3, "2;5;six;7"), ("a", 4, "   "), ("a", 5, "3;5;6;"),
            ("a", 6, "4;5;6;7;8"), ("a", 7, "5;1d;;x"), ("a", 8, "6;5,5;6;7"),
            ("b", 1, "word"), ("b", 2, "other"), ("c", 1, ""), ("d", 1, "5 6 7"), ("d", 2, "5 6 bad")]
    lines = spark.createDataFrame(rows, LINES)
    got = {(r.source_file, r.line_no): (r["column"], r.reason) for r in reject_lines(lines).collect()}
    assert got == {("a", 1): (None, "header"), ("a", 3): ("y", "not a number"), ("a", 4): (None, "blank"),
                   ("a", 5): ("h", "missing value"), ("a", 6): (None, "too many cells"), ("a", 7): ("x", "not a number"),
                   ("b", 1): (None, "no layout"), ("b", 2): (None, "no layout"), ("c", 1): (None, "blank"),
                   ("d", 2): ("h", "not a number")}
    assert parse_points(lines, on_bad="quarantine").count() + len(got) == len(rows)
    assert reject_lines(lines.limit(0)).collect() == []


def test_no_line_is_split_in_a_filter(spark):
    """A filter on the reason would repeat the splitting of a line for every cell it asks for."""
    lines = spark.createDataFrame([("a", 1, "1;5;6;7"), ("a", 2, "2;5;six;7")], LINES)
    plan = reject_lines(lines)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("split(" in p for p in plan)
    assert not [p for p in plan if "Filter" in p and "split(" in p]
