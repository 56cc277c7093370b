"""Statistics as expressions: intervals and exact tests."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a 95 % interval.
Z = 1.959963984540054


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wilson(hits: Column | str, n: Column | str, z: float = Z) -> Column:
    """Struct of low and high, within [0, 1]; (0, 0) for n = 0."""
    n = _col(n).cast("double")
    p, z2 = _col(hits).cast("double") / n, z * z
    centre, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    bound = lambda x: F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / (1 + z2 / n)))).otherwise(0.0)
    return F.struct(bound(centre - half).alias("low"), bound(centre + half).alias("high"))


#: Nodes and weights of the panels that the tail of a binomial is summed over, and how far: e^-FAR is nothing beside 1.
PANELS, FAR = 8, 40.0


def _nodes() -> list[tuple[float, float]]:
    x, w = np.polynomial.legendre.leggauss(16)
    return [((2 * i + 1 + float(a)) / (2 * PANELS), float(b) / (2 * PANELS)) for i in range(PANELS) for a, b in zip(x, w, strict=True)]


def _stirling_error(k: Column) -> Column:
    """log(k!) less Stirling's formula, for k >= 1."""
    small = F.array(*(F.lit(math.lgamma(i + 1) - (0.5 * math.log(2 * math.pi * i) + i * math.log(i) - i)) for i in range(1, 17)))
    x = k.cast("double")
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * x * x)) / (x * x)) / (x * x)) / (x * x)) / x
    return F.when(k <= 16, F.get(small, (k - 1).cast("int"))).otherwise(series)


def log_mcnemar(a_only: Column | str, b_only: Column | str) -> Column:
    """The logarithm of the two-sided exact p-value, finite for any counts; constant work a row.

    With m the smaller count of n, 2 P(X <= m) = 2 C(n, m) / 2^n * (n - m) * integral over u from 0 to 1 of
    (1 - u)^(n - m - 1) (1 + u)^m. The first factor comes from the deviance and Stirling's errors, so nothing cancels; the
    integral, which falls from 1, is taken by a fixed number of nodes as far as it counts.
    """
    a, b = _col(a_only).cast("long"), _col(b_only).cast("long")
    n, m = (a + b).cast("double"), F.least(a, b).cast("double")
    d = (n - 2 * m) / n  # 0 to 1
    near = sum((F.pow(d, F.lit(2 * j)) / (j * (2 * j - 1)) for j in range(1, 17)), F.lit(0.0))
    deviance = n / 2 * F.when(d < 0.3, near).otherwise((1 - d) * F.log1p(-d) + (1 + d) * F.log1p(d))
    errors = _stirling_error(a + b) - _stirling_error(F.least(a, b)) - _stirling_error(F.greatest(a, b))
    log_term = F.when(m == 0, -n * math.log(2)).otherwise(errors - deviance + 0.5 * F.log(n / (2 * math.pi * m * (n - m))))
    reach = F.least(F.lit(1.0), FAR / F.greatest(F.lit(1.0), n - 2 * m - 1), F.sqrt(2 * FAR / F.greatest(F.lit(1.0), n - 1)))
    nodes = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in _nodes()))
    area = F.aggregate(nodes, F.lit(0.0), lambda s, q: s + q["w"] * F.exp((n - m - 1) * F.log1p(-reach * q["x"]) + m * F.log1p(reach * q["x"])))
    whole = math.log(2) + log_term + F.log(n - m) + F.log(reach) + F.log(area)
    return F.when(a + b == 0, 0.0).when(a == b, 0.0).otherwise(F.least(F.lit(0.0), whole))


def mcnemar(a_only: Column | str, b_only: Column | str) -> Column:
    """Two-sided exact p-value of the discordant counts; 1 without any."""
    return F.exp(log_mcnemar(a_only, b_only))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole, 0 where there is no whole."""
    w = _col(whole).cast("double")
    return F.when(w > 0, _col(part) / w).otherwise(0.0)
