"""Functions over probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities are kept this far from 0 and 1 before logarithms.
EPS = 1e-6


def clipped(p: Column) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p)))


def logit(p: Column) -> Column:
    return F.ln(clipped(p) / (1 - clipped(p)))


def sigmoid(x: Column) -> Column:
    """Stable at both ends: no exponential of a large positive number."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
