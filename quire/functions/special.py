"""Mathematical functions that Spark lacks, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Lanczos' approximation for g = 7, n = 9.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _upper(x: Column) -> Column:
    """Gamma for arguments of at least 0.5."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(math.sqrt(2 * math.pi)) * F.pow(t, z + 0.5) * F.exp(-t) * total


def gamma(x: Column) -> Column:
    """The gamma function; null at zero and the negative integers, where it has poles, and for null."""
    x = x.cast("double")
    pole = (x <= 0) & (x == F.floor(x))
    low = F.pi() / (F.sin(F.pi() * x) * _upper(1 - x))
    return F.when(pole | x.isNull(), None).when(x < 0.5, low).otherwise(_upper(x))
