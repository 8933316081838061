import pytest

from levelling.operators.axes import ZoneMismatch, check_zones, roles_from_first
from levelling.plans.pipelines import compare
from levelling.sinks.writers import output_name


def pts(spark, rows):
    return spark.createDataFrame(rows, "id string, x double, y double, h double, k long")


@pytest.mark.parametrize("kw", [{"max_distance": -1}, {"decimals": 7}, {"tolerance": -0.1},
                                {"height_tolerance": -1.0}])
def test_parameter_domains(spark, kw):
    p = pts(spark, [("a", 1.0, 2.0, 3.0, 1)])
    with pytest.raises(ValueError):
        compare(p, key="k", reference=p, **kw)


def test_needs_a_source(spark):
    p = pts(spark, [("a", 1.0, 2.0, 3.0, 1)])
    with pytest.raises(ValueError):
        compare(p, key="k")


def test_roles_from_first_row():
    r = roles_from_first(5958143.5, 7466893.08)
    assert (r.northing, r.easting) == ("x", "y")
    r = roles_from_first(7466893.08, 1234.0)
    assert (r.northing, r.easting) == ("y", "x")
    r = roles_from_first(1.0, 2.0)
    assert (r.northing, r.easting) == ("x", "y")
    r = roles_from_first(float("nan"), float("inf"))
    assert (r.northing, r.easting) == ("x", "y")


def test_zone_check(spark):
    a = pts(spark, [("a", 5958143.5, 7466893.08, 1.0, 1)])
    b = spark.createDataFrame([(1, 5958143.5, 6466893.08)], "seq int, x double, y double")
    with pytest.raises(ZoneMismatch):
        check_zones(a, "k", b, "seq")
    c = spark.createDataFrame([(1, 5958143.5, 7400000.0)], "seq int, x double, y double")
    assert check_zones(a, "k", c, "seq") == (2178, 2178)


def test_output_names():
    assert output_name(4, "wynik_geoportal", "gpkg") == "tryb-4_wynik_geoportal.gpkg"
