"""Missing values: one contract for NULL and NaN.

A value is missing when it is NULL or, in a floating column, NaN; labels likewise. Every reduction exists in a form that
skips missing values and one that they propagate through; a missing result is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, T.FloatType | T.DoubleType)


def present(c: Column, kind: T.DataType) -> Column:
    """The value, or NULL where it is missing."""
    return F.when(~F.isnan(c), c) if is_floating(kind) else c


def missing(c: Column, kind: T.DataType) -> Column:
    return (c.isNull() | F.isnan(c)) if is_floating(kind) else c.isNull()
