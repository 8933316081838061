import pytest

from levelling.functions.projection import project_2000_to_1992, project_point


def test_anchor_points():
    e, n = project_point(5958143.50, 7466893.08, 7)
    assert e == pytest.approx(598742.8340, abs=1e-4)
    assert n == pytest.approx(655355.5664, abs=1e-4)
    e, n = project_point(5955909.72, 7466350.05, 7)
    assert e == pytest.approx(598263.1394, abs=1e-4)
    assert n == pytest.approx(653108.5510, abs=1e-4)


def test_spark_matches_scalar_and_null_zone(spark):
    rows = [(5958143.50, 7466893.08, 7), (5600000.0, 5500000.0, 5), (6000000.0, 8400000.0, 8), (1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "n double, e double, zone int")
    out = project_2000_to_1992(df, "n", "e", "zone").collect()
    for r in out[:3]:
        e, n = project_point(r["n"], r["e"], r["zone"])
        assert r["e_1992"] == pytest.approx(e, abs=1e-6)
        assert r["n_1992"] == pytest.approx(n, abs=1e-6)
    assert out[3]["e_1992"] is None and out[3]["n_1992"] is None


def _exact(n, e, zone):
    """Gauss-Krueger by its definition, without a series in the flattening.

    The complex isometric latitude is conformal; its inverse is found by
    Newton steps and the meridian arc by Gauss-Legendre quadrature along the
    complex path.  Public GRS80 and EPSG parameters, none from the library.
    """
    import numpy as np
    a, inv = 6378137.0, 298.257222101
    e2 = (2 - 1 / inv) / inv
    ecc = np.sqrt(e2)
    node, weight = np.polynomial.legendre.leggauss(40)

    def arc(phi):
        t = phi[..., None] * (node + 1) / 2
        return a * (1 - e2) * phi / 2 * (weight * (1 - e2 * np.sin(t) ** 2) ** -1.5).sum(axis=-1)

    def isometric(phi):
        s = np.sin(phi)
        return np.arctanh(s) - ecc * np.arctanh(ecc * s)

    def newton(f, slope, target, x):
        for _ in range(12):
            x = x - (f(x) - target) / slope(x)
        return x

    def arc_slope(p):
        return a * (1 - e2) * (1 - e2 * np.sin(p) ** 2) ** -1.5

    def iso_slope(p):
        return (1 - e2) / ((1 - e2 * np.sin(p) ** 2) * np.cos(p))
    z = (n + 1j * (e - zone * 1e6 - 500000.0)) / 0.999923
    phi = newton(arc, arc_slope, z, z / 6367449.0)
    q = isometric(phi) + 1j * np.radians(3.0 * zone - 19.0)
    phi = newton(isometric, iso_slope, q, phi.real + 1j * q.imag * np.cos(phi.real))
    out = 0.9993 * arc(phi)
    return out.imag + 500000.0, out.real - 5300000.0


def test_projection_matches_the_definition(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    zone = rng.integers(5, 9, 400)
    n = rng.uniform(5430000, 6080000, 400)
    e = zone * 1e6 + rng.uniform(400000, 600000, 400)
    east, north = _exact(n, e, zone)
    df = spark.createDataFrame([(i, float(a), float(b), int(z)) for i, (a, b, z) in enumerate(zip(n, e, zone))],
                               "i int, n double, e double, zone int")
    for r in project_2000_to_1992(df, "n", "e", "zone").collect():
        assert r["e_1992"] == pytest.approx(east[r["i"]], abs=1e-5)
        assert r["n_1992"] == pytest.approx(north[r["i"]], abs=1e-5)
