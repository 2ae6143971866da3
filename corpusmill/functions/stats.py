"""Statistics as columns: Wilson interval, exact binomial in log space, nearest-rank places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of the 95 % interval; (0, 0) for n = 0."""
    p, d = hits / n, 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return tuple(F.when(n == 0, F.lit(0.0)).otherwise(x) for x in (F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)))


def binomial_two_sided(b: str, c: str) -> Column:
    """min(1, 2 * sum of C(n, i) / 2^n for i <= min(b, c)), n = b + c; 1 for n = 0. Sums logarithms, so large n don't overflow."""
    return F.expr(
        f"""CASE WHEN {b} + {c} = 0 THEN 1D ELSE least(1D, 2 * aggregate(sequence(0, CAST(least({b}, {c}) AS INT)),
              named_struct('t', -({b} + {c}) * ln(2D), 's', 0D),
              (a, i) -> named_struct('t', a.t + ln(greatest({b} + {c} - i, 1)) - ln(i + 1D), 's', a.s + exp(a.t)), a -> a.s)) END"""
    )


def stderr(p: Column, n: Column) -> Column:
    return F.sqrt(p * (1 - p) / n)
