import os

import pytest

from levelling.operators import ledger
from levelling.sinks.writers import write_csv


def test_csv_outputs_run_the_plan_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def touch(it):
        for pdf in it:
            seen.add(len(pdf))
            yield pdf
    rows = [("a", "x", "Tak"), ("b", None, "Nie"), ("c", None, None)]
    schema = "id_odniesienia string, id_porownania string, osiaga_dokladnosc string"
    df = spark.createDataFrame(rows, schema).mapInPandas(touch, schema)
    counts = write_csv(df, str(tmp_path / "r.csv"))
    assert counts == {"n_rows": 3, "n_paired": 1, "n_accurate": 1, "n_inaccurate": 1, "n_unflagged": 1}
    assert seen.value == 3
    back = spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "r.csv_split"))
    assert sorted((r.id_odniesienia, r.id_porownania, r.dokladnosc) for r in back.collect()) == [
        ("a", "x", "dokladne"), ("b", "brak_danych", "niedokladne"), ("c", "brak_danych", "niedokladne")]
    assert write_csv(df.limit(0), str(tmp_path / "none.csv"))["n_rows"] == 0
    assert not os.path.exists(tmp_path / "none.csv")


def service(folder, broken=False):
    """Leaves every third key out the first time it is asked, never answers northing 7.00 and logs every request."""
    def fetch(batch):
        out = []
        for e, n in batch:
            path = os.path.join(folder, f"{round(n * 100)}")
            again = os.path.exists(path)
            with open(path, "a") as f:
                f.write("x")
            if broken and round(n * 100) == 1500:
                raise ValueError("the run ends here")
            if round(n * 100) != 700 and (again or round(n) % 3):
                out.append(f"{n:.2f} {e:.2f} {n + e}")
        return ",".join(out)
    return fetch


def test_ledger_goes_on_where_a_run_ended(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    keys = spark.createDataFrame([(100 * i, 200) for i in range(1, 41)] + [(100, 200), (None, 1)], "n_cm long, e_cm long")
    folder, options = str(tmp_path / "ledger"), dict(slices=4, tasks=2, batch_size=5, attempts=1)
    with pytest.raises(Exception, match="the run ends here"):
        ledger.ask_all(keys, service(str(asked), broken=True), folder, **options)
    done = ledger.ledger(spark, folder, slices=4)
    before = {r.n_cm for r in done.collect()}
    times = {n: len((asked / str(n)).read_text()) for n in before}
    assert len(before) < 40
    rows = ledger.ask_all(keys, service(str(asked)), folder, **options)
    status = {r.n_cm: r for r in ledger.key_status(rows).collect()}
    assert sorted(status) == [100 * i for i in range(1, 41)]
    for n, r in status.items():
        assert (r.outcome == "answered") == (n != 700) and (r.h_ref is None) == (n == 700)
        if n in before:  # asked once in each pass, however often the run was started
            assert len((asked / str(n)).read_text()) == times[n] + r.passes - 1
    counts = ledger.ledger_counts(rows).first()
    assert (counts.n_asked, counts.n_open) == (40, 1) and counts.n_retried == counts.n_recovered + 1
    again = ledger.ask_all(keys, None, folder, **options)  # nothing is left to ask
    assert again.count() == rows.count()


def test_ledger_of_no_keys(spark, tmp_path):
    keys = spark.createDataFrame([], "n_cm long, e_cm long")
    rows = ledger.ask_all(keys, None, str(tmp_path / "l"), slices=2, tasks=1)
    assert rows.count() == 0 and ledger.ledger_counts(rows).first().n_asked == 0
