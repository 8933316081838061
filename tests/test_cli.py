import os

from pyspark.sql import functions as F

from levelling.cli import run
from levelling.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _points_file(spark, d, name, src, with_h=True):
    rows = src.orderBy("k").collect()
    path = os.path.join(d, name)
    with open(path, "w") as f:
        f.write("nr;x;y;h\n" if with_h else "nr;x;y\n")
        for r in rows:
            cells = [r["id"], f"{r['x']:.2f}".replace(".", ","), f"{r['y']:.2f}".replace(".", ",")]
            if with_h:
                cells.append(f"{r['h']:.2f}".replace(".", ","))
            f.write(";".join(cells) + "\n")
    return path


def test_mode_1_and_2_with_thinning(spark, tmpdir_fresh):
    pts = _points_file(spark, tmpdir_fresh, "pts.csv", fx.inp(spark, SF))
    ref = _points_file(spark, tmpdir_fresh, "ref.csv", fx.cmp(spark, SF))
    out = os.path.join(tmpdir_fresh, "out")
    w = run(spark, ["--mode", "1", "--points", pts, "--reference", ref, "--out", out])
    csv = spark.read.option("sep", ";").option("header", True).csv(w["csv"])
    assert csv.count() == 1500 and os.path.basename(w["csv"]) == "tryb-1_wynik.csv"
    assert csv.where(F.col("osiaga_dokladnosc") == "Tak").count() == 501

    heights = os.path.join(tmpdir_fresh, "heights")
    fx.heights_projected(spark, SF).write.parquet(heights)
    scope = os.path.join(tmpdir_fresh, "scope.txt")
    with open(scope, "w") as f:
        f.write("\n".join(f"W{i};{x:.2f};{y:.2f}" for i, (x, y) in enumerate(fx.SCOPE_POLYGON)) + "\n")
    w = run(spark, ["--mode", "2", "--points", pts, "--heights", heights, "--scope", scope,
                    "--thin-spacing", "25", "--out", out])
    assert spark.read.parquet(w["layer"]).count() == 1500
    assert spark.read.option("sep", ";").option("header", True).csv(w["thinned_csv"]).count() > 0


def test_mode_5(spark, tmpdir_fresh):
    heights = os.path.join(tmpdir_fresh, "heights")
    fx.heights_projected(spark, SF).write.parquet(heights)
    scope = os.path.join(tmpdir_fresh, "scope.txt")
    with open(scope, "w") as f:
        f.write("\n".join(f"{x:.2f} {y:.2f}" for x, y in fx.SCOPE_POLYGON) + "\n")
    out = os.path.join(tmpdir_fresh, "out5")
    w = run(spark, ["--mode", "5", "--scope", scope, "--spacing", "25", "--heights", heights, "--out", out])
    csv = spark.read.option("sep", ";").option("header", True).csv(w["csv"])
    assert csv.count() == 4142
    assert set(csv.columns) == {"id_odniesienia", "x_odniesienia", "y_odniesienia", "h_geoportal"}
