"""Interval and test statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Z95 = 1.959963984540054


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """95% score interval of a proportion."""
    k, m = successes.cast("double"), n.cast("double")
    p, z2 = k / m, Z95 * Z95
    mid = (p + z2 / (2 * m)) / (1 + z2 / m)
    half = Z95 / (1 + z2 / m) * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


@F.pandas_udf(DoubleType())
def exact_sign_p(only_a: pd.Series, only_b: pd.Series) -> pd.Series:
    """Two-sided exact binomial p at one half. Used on a handful of aggregated rows.

    Terms fall off from the largest, so a few standard deviations of them are all of the sum.
    """

    def p_value(a: int, b: int) -> float:
        n, k = a + b, min(a, b)
        if n == 0:
            return 1.0
        head = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
        i = np.arange(k, max(-1, k - int(40 * math.sqrt(n)) - 60), -1, dtype=float)
        ratios = np.concatenate([[1.0], np.cumprod(i[:-1] / (n - i[:-1] + 1))])
        return min(1.0, 2 * math.exp(head) * float(ratios.sum()))

    return pd.Series([p_value(int(a), int(b)) for a, b in zip(only_a, only_b)])
