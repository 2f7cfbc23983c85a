"""Array columns to rows and back: the trailing dimension of an n-dimensional array."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.operators.reduce import group_reduce
from gridfold.plans.keys import Key


def to_long(df: DataFrame, column: str, dim: str = "pos", value: str = "value", keep_empty: bool = False) -> DataFrame:
    """One row for each element, with its position from 0. A null or empty array has none, or one without, by ``keep_empty``."""
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return df.select(*[c for c in df.columns if c != column], explode(column).alias(dim, value))


def to_array(df: DataFrame, by: Sequence[str], dim: str = "pos", value: str = "value", into: str = "array") -> DataFrame:
    """The values of each group as an array in the order of ``dim``. An array must fit in a row."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(dim).alias("at"), F.col(value).alias("v"))))
    return df.groupBy(*by).agg(F.transform(ordered, lambda s: s["v"]).alias(into))


def reduce_elementwise(df: DataFrame, column: str, *keys: str | Key, func: Any, dim: str = "pos", **options: Any) -> DataFrame:
    """Reduce an array column over the rows of each group, position by position: the array's own dimension is kept."""
    return group_reduce(to_long(df, column, dim, "value"), "value", *keys, func=func, keep_dims=[dim], **options)
