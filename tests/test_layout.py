import random

import pytest

from levelling.sources import delimited as dl
from levelling.sources import layout


def _files(folder, seed=5):
    """Files of several layouts, with blank, too wide and unreadable lines, some cut into many splits."""
    r = random.Random(seed)
    texts = {}
    for i, (sep, cols, head) in enumerate([(";", 4, True), (",", 3, False), (" ", 4, False), (";", 70, False), ("\t", 5, True)]):
        lines = ["", "  "] if i % 2 else []
        if head:
            lines.append(sep.join(f"c{j}" for j in range(cols)))
        for k in range(r.randrange(200, 400)):
            row = [f"{r.uniform(1, 9):.2f}" for _ in range(cols)]
            if cols == 70:
                row[4:69] = [""] * 65
            lines.append(sep.join(row))
            if k % 37 == 0:
                lines.append("")
            if k % 41 == 0:
                lines.append(sep.join(row + ["7", "8"]))
        texts[f"f{i}.txt"] = "\n".join(lines) + "\n"
    for name, t in texts.items():
        (folder / name).write_text(t)
    return [str(folder / n) for n in texts]


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("split", ["9000b", "64m"])
@pytest.mark.parametrize("on_bad", ["fail", "drop", "quarantine", "keep"])
def test_rows_equal_those_of_the_table_of_lines(spark, tmp_path, split, on_bad):
    paths = _files(tmp_path)
    if on_bad != "fail":
        (tmp_path / "bad.txt").write_text("1;5;6;7\n2;5;six;7\n3;5;6;\n")
        (tmp_path / "prose.txt").write_text("word\nother\n")
        (tmp_path / "empty.txt").write_text("")
        paths += [str(tmp_path / n) for n in ("bad.txt", "prose.txt", "empty.txt")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = layout.read_text(spark, paths, on_bad=on_bad)
        want = dl.parse_points(dl.read_lines(spark, paths), on_bad=on_bad)
        assert got.columns == want.columns and _sorted(got) == _sorted(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scope_and_bad_files(spark, tmp_path):
    (tmp_path / "s.txt").write_text("id;x;y\n\na;1,5;2\nb;3;4\nc;5;6;9\nd;7;8\n")
    got = layout.read_text(spark, [str(tmp_path / "s.txt")], "scope", swap_xy=True)
    assert [tuple(r)[1:] for r in got.orderBy("seq").collect()] == [
        (3, "a", 2.0, 1.5), (4, "b", 4.0, 3.0), (6, "d", 8.0, 7.0)]
    for text, why in (("", "no rows"), ("word\nother\n", "no separator"), ("1;2;3;4\n1;2;x;4\n", "non-numeric")):
        (tmp_path / "t.txt").write_text(text)
        with pytest.raises(dl.BadFileError, match=why):
            layout.read_text(spark, [str(tmp_path / "t.txt")])


def test_text_is_read_three_times(spark, tmp_path, monkeypatch):
    reads = []

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Scan text")

    def stored(df, keep=layout._stored):
        reads.append(scans(df))
        return keep(df)
    monkeypatch.setattr(layout, "_stored", stored)
    out = layout.read_text(spark, _files(tmp_path), on_bad="drop")
    assert sum(reads) + scans(out) == 3
    assert "SortAggregate" not in layout.layout_state(
        layout._raw(spark, _files(tmp_path)), dl.SEPARATORS)._jdf.queryExecution().executedPlan().toString()
