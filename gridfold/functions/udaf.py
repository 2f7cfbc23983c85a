"""User-defined aggregations and scans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, WindowSpec

from gridfold.functions.aggregates import Measure


@dataclass(frozen=True)
class GroupAgg:
    """An algebraic aggregation: named parts, each a built-in aggregate of the measure, and an expression of their results.

    Catalyst plans partial aggregation of the parts, so nothing but them is shuffled. ``preprocess`` maps the value first.
    """

    name: str
    parts: dict[str, Callable[[Measure], Column]]
    finalize: Callable[[dict[str, Column]], Column]
    preprocess: Callable[[Column], Column] | None = None
    absent: Any = None
    dtype: str | None = None
    ordered: bool = False


@dataclass(frozen=True)
class HolisticAgg:
    """An aggregation that needs all valid values of a group at once: ``function`` gets them as a series, in Arrow batches.

    A group must fit in a Python worker.
    """

    name: str
    function: Callable[[pd.Series], Any]
    dtype: str = "double"
    absent: Any = None


@dataclass(frozen=True)
class GroupScan:
    """A scan by a window expression: ``expression`` gets the measure and the frame from the first row of the group up to
    this one (``reverse``: from this one to the last)."""

    name: str
    expression: Callable[[Measure, WindowSpec], Column]
    reverse: bool = False


@dataclass(frozen=True)
class PandasScan:
    """A scan by a function from a group's values, in order, to as many results. A group must fit in a Python worker."""

    name: str
    function: Callable[[pd.Series], pd.Series]
    dtype: str = "double"
