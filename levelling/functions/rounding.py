"""Rounding expressions.

Two rounding rules are needed for result parity (SURVEY Q5):

* ``rint_n`` -- round half to even on the scaled double, ``rint(v*10^n)/10^n``.
  This is how whole columns of results are rounded.
* ``py_round`` -- correct rounding of the *exact* binary value of ``v`` to ``n``
  decimals, half to even.  Used for height differences and pair distances.
  ``v*10^n`` is formed as an exact sum ``t + e`` (Dekker's split product) so
  that the decision does not depend on the rounding error of the product.

``F.round`` (half up) and ``F.bround`` (decimal half-even) give different
answers on binary ties and must not be used for these columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1, Veltkamp splitter for doubles


def _scale(n: int) -> float:
    if not 0 <= int(n) <= 15:
        raise ValueError("decimals must be between 0 and 15")
    return float(10 ** int(n))


def rint_n(c: Column | str, n: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    s = _scale(n)
    return F.rint(c * F.lit(s)) / F.lit(s)


def py_round(c: Column | str, n: int) -> Column:
    v = F.col(c) if isinstance(c, str) else c
    s = F.lit(_scale(n))
    t = v * s
    cc = v * F.lit(_SPLIT)
    hi = cc - (cc - v)
    e = (hi * s - t) + (v - hi) * s
    k = F.floor(t).cast("double")
    r = (t - k - F.lit(0.5)) + e
    k_even = F.pmod(k, F.lit(2.0)) == F.lit(0.0)
    q = (F.when(r > 0, k + 1).when(r < 0, k).when(k_even, k).otherwise(k + 1))
    return q / s


def no_negative_zero(c: Column | str) -> Column:
    """Turn ``-0.0`` into ``0.0`` (the reference does this for differences)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == F.lit(0.0), F.lit(0.0)).otherwise(c)


def rounded_difference(a: Column | str, b: Column | str, n: int) -> Column:
    """``a - b`` rounded like Python ``round`` with the sign of zero dropped."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return no_negative_zero(py_round(a - b, n))
