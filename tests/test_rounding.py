import random

import numpy as np
from pyspark.sql import functions as F

from levelling.functions.rounding import py_round, rint_n, rounded_difference


def test_py_round_matches_python(spark):
    rnd = random.Random(7)
    vals = [rnd.randint(-200000, 200000) / 1000.0 for _ in range(3000)]
    vals += [rnd.uniform(-1000, 1000) for _ in range(2000)]
    vals += [0.125, 0.375, 2.675, -0.125, 1.005, 0.5, 1.5, 2.5, -2.5]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for n in (0, 1, 2, 3):
        got = [r[0] for r in df.select(py_round("v", n)).collect()]
        assert got == [round(v, n) for v in vals], n


def test_rint_n_matches_numpy(spark):
    rnd = random.Random(3)
    vals = [rnd.randint(-200000, 200000) / 100.0 for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for n in (0, 1, 2):
        got = [r[0] for r in df.select(rint_n("v", n)).collect()]
        assert got == [float(x) for x in np.round(np.array(vals), n)], n


def test_difference_has_no_negative_zero(spark):
    df = spark.createDataFrame([(1.0, 1.004), (2.0, 2.0)], "a double, b double")
    got = [r[0] for r in df.select(rounded_difference("a", "b", 2)).collect()]
    assert all(str(v) == "0.0" for v in got)
