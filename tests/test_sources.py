import os

import pytest

from levelling.sources.delimited import BadFileError, read_points, read_scope


def write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def rows(df):
    return [(r["id"], r["x"], r["y"], r["h"]) for r in df.orderBy("row_no").collect()]


def test_readme_sample(spark, tmpdir_fresh):
    p = write(tmpdir_fresh, "a.txt", "1001;5958143.50;7466893.08;137.90\n1002;5955909.72;7466350.05;138.82\n")
    assert rows(read_points(spark, p)) == [("1001", 5958143.50, 7466893.08, 137.90),
                                           ("1002", 5955909.72, 7466350.05, 138.82)]


@pytest.mark.parametrize("text,expected", [
    ("nr;x;y;h\na;1;2;3\n", [("a", 1.0, 2.0, 3.0)]),
    ("a;1;2;\nb;1;2;3\n", [("b", 1.0, 2.0, 3.0)]),
    ("1;5958143,50;7466893,08;137,90\n", [("1", 5958143.50, 7466893.08, 137.90)]),
    ("a;1;2;3;\nb;4;5;6;\n", [("a", 1.0, 2.0, 3.0), ("b", 4.0, 5.0, 6.0)]),
    ("a;1;2;3\nb;1;2;3;4;5\nc;7;8;9\n", [("a", 1.0, 2.0, 3.0), ("c", 7.0, 8.0, 9.0)]),
    ("a;1e3;+3; 12 \n", [("a", 1000.0, 3.0, 12.0)]),
    ("a;1;2;3\nNA;4;5;6\n", [("a", 1.0, 2.0, 3.0), (None, 4.0, 5.0, 6.0)]),
    ("NA;1;2;3\n", [("P_1", 1.0, 2.0, 3.0)]),  # all-missing id column is dropped: 3 columns
    ('"a;b";1;2;3\n', [("a;b", 1.0, 2.0, 3.0)]),
    ("a;1;2;3\n\n#c;4;5;6\n", [("a", 1.0, 2.0, 3.0), ("#c", 4.0, 5.0, 6.0)]),
    ("1;2;3;4;abc\n5;6;7;8;xyz\n", [("5", 6.0, 7.0, 8.0)]),
    ("1,2,3\n4,5,6\n", [("P_1", 1.0, 2.0, 3.0), ("P_2", 4.0, 5.0, 6.0)]),
    ("1001 5958143.50\t7466893.08  137.90\n", [("1001", 5958143.50, 7466893.08, 137.90)]),
])
def test_edge_lines(spark, tmpdir_fresh, text, expected):
    p = write(tmpdir_fresh, "f.csv", text)
    assert rows(read_points(spark, p)) == expected


@pytest.mark.parametrize("bad", ["x", "1d", "1.5f", "0x10", "1_000"])
def test_bad_numbers_reject_the_file(spark, tmpdir_fresh, bad):
    p = write(tmpdir_fresh, "f.csv", f"a;1;2;3\nb;1;2;{bad}\n")
    with pytest.raises(BadFileError):
        read_points(spark, p)


def test_too_narrow_row_rejects_the_file(spark, tmpdir_fresh):
    p = write(tmpdir_fresh, "f.csv", "a;1;2;3\nb;1\n")
    with pytest.raises(BadFileError):
        read_points(spark, p)


def test_whitespace_with_decimal_comma(spark, tmpdir_fresh):
    p = write(tmpdir_fresh, "f.txt", "1001 5958143,50 7466893,08 137,90\n")
    with pytest.raises(BadFileError):
        read_points(spark, p)  # ',' is tried before whitespace (parity)
    assert rows(read_points(spark, p, sep="whitespace")) == [("1001", 5958143.50, 7466893.08, 137.90)]


def test_swap_and_no_height(spark, tmpdir_fresh):
    p = write(tmpdir_fresh, "f.txt", "P1;5958143.50;7466893.08\nP2;5955909.72;7466350.05\n")
    got = read_points(spark, p, has_height=False, swap_xy=True).orderBy("row_no").collect()
    assert [(r["id"], r["x"], r["y"]) for r in got] == [("P1", 7466893.08, 5958143.50), ("P2", 7466350.05, 5955909.72)]


def test_scope_file(spark, tmpdir_fresh):
    p = write(tmpdir_fresh, "s.txt", "nr;x;y\nW1;5958143.50;7466893.08\nW2;5955909.72;7466350.05\nW3;5955900.00;7466900.00\n")
    got = read_scope(spark, p).orderBy("seq").collect()
    assert [(r["id"], r["x"], r["y"]) for r in got] == [("W1", 5958143.50, 7466893.08), ("W2", 5955909.72, 7466350.05),
                                                         ("W3", 5955900.00, 7466900.00)]


def test_many_files_and_splits(spark, tmpdir_fresh):
    paths = []
    for f in range(3):
        lines = "\n".join(f"{f}_{i};{i}.5;{i * 2}.25;{i % 97}" for i in range(2000))
        paths.append(write(tmpdir_fresh, f"m{f}.csv", lines + "\n"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = read_points(spark, paths)
        got = df.select("source_file", "row_no", "id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for r in got:
        f, i = r["id"].split("_")
        assert r["row_no"] == int(i) + 1 and r["source_file"].endswith(f"m{f}.csv")
    assert len(got) == 6000
