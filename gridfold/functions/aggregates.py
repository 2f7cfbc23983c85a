"""The reductions, each one as built-in aggregate expressions, so that Catalyst plans partial and final aggregation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.functions.missing import is_floating, missing, present

#: Doubles hold every whole number up to here.
EXACT = 2.0**53
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class Measure:
    """What a reduction sees of the rows of a group: the value, its type, the ordinal of the row, and the options."""

    value: Column
    kind: T.DataType
    order: Column | None = None
    ddof: int = 0
    q: float | list[float] | None = None

    @property
    def valid(self) -> Column:
        return present(self.value, self.kind)

    @property
    def number(self) -> Column:
        """The value as a number: booleans count as 0 and 1, timestamps as microseconds."""
        if isinstance(self.kind, T.BooleanType):
            return self.value.cast("bigint")
        if isinstance(self.kind, T.TimestampType):
            return F.unix_micros(self.value)
        if isinstance(self.kind, T.TimestampNTZType):
            return F.unix_micros(F.to_utc_timestamp(self.value.cast("timestamp"), F.current_timezone()))
        return self.value

    @property
    def valid_number(self) -> Column:
        return present(self.number, self.kind)

    @property
    def any_missing(self) -> Column:
        return F.max(missing(self.value, self.kind))

    @property
    def truth(self) -> Column:
        return self.value if isinstance(self.kind, T.BooleanType) else self.value != 0

    def unless_missing(self, result: Column) -> Column:
        return F.when(~self.any_missing, result)

    def time(self, micros: Column) -> Column:
        """A number of microseconds as the value's type, if that is a timestamp."""
        if isinstance(self.kind, T.TimestampType):
            return F.timestamp_micros(F.round(micros).cast("bigint"))
        if isinstance(self.kind, T.TimestampNTZType):
            return F.from_utc_timestamp(F.timestamp_micros(F.round(micros).cast("bigint")), F.current_timezone()).cast("timestamp_ntz")
        return micros


@dataclass(frozen=True)
class Reduction:
    """``compute`` makes the aggregate; ``absent`` is the result of a group without rows, unless a fill value is given."""

    name: str
    compute: Callable[[Measure], Column]
    absent: Any = None
    ordered: bool = False
    shifted: bool = False  # numerically better after subtracting a value of the group
    result: str = "same"  # same, count, sum, floating, bool, position
    algebraic: bool = True  # can be updated row by row in a stream
    types: tuple[type, ...] | None = field(default=None)  # of values, if not all


def _spread(m: Measure, valid: Column) -> Column:
    n = F.count(valid)
    if m.ddof == 0:
        return F.var_pop(valid)
    return F.when(n > m.ddof, F.var_pop(valid) * n / (n - m.ddof))


def _quantile(m: Measure, valid: Column) -> Column:
    q = m.q if m.q is not None else 0.5
    found = F.percentile(valid, F.array(*[F.lit(float(x)) for x in q]) if isinstance(q, list | tuple) else F.lit(float(q)))
    return F.transform(found, m.time) if isinstance(q, list | tuple) else m.time(found)


def _arg_max(m: Measure) -> Column:
    return F.max_by(m.order, F.struct(missing(m.value, m.kind), m.value, -m.order))


def _arg_min(m: Measure) -> Column:
    return F.min_by(m.order, F.struct(~missing(m.value, m.kind), m.value, m.order))


def _valid_order(m: Measure) -> Column:
    return F.when(m.valid.isNotNull(), m.order)


def _plain_sum(m: Measure) -> Column:
    return F.sum(m.number)


def _product(m: Measure, c: Column) -> Column:
    """Spark's product is a double. Of whole numbers it is exact up to 2^53; a larger one raises rather than lose digits."""
    found = F.product(c)
    if isinstance(m.kind, INTEGERS) or isinstance(m.kind, T.BooleanType):
        return F.when(F.abs(found) > EXACT, F.raise_error(F.lit("a product of whole numbers is beyond 2^53: cast the values to double"))).otherwise(found).cast("bigint")
    return found


NUMERIC = (T.NumericType, T.BooleanType)
TIMED = (T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)

_ALL = [
    Reduction("count", lambda m: F.count(m.valid), 0, result="count"),
    Reduction("sum", lambda m: m.unless_missing(_plain_sum(m)), result="sum", types=(*NUMERIC, T.DayTimeIntervalType)),
    Reduction("nansum", lambda m: F.coalesce(F.sum(m.valid_number), F.lit(0)), result="sum", types=NUMERIC),
    Reduction("prod", lambda m: m.unless_missing(_product(m, m.number)), 1, result="sum", types=NUMERIC),
    Reduction("nanprod", lambda m: F.coalesce(_product(m, m.valid_number), F.lit(1)), 1, result="sum", types=NUMERIC),
    Reduction("mean", lambda m: m.unless_missing(m.time(F.avg(m.number))), result="floating", types=TIMED),
    Reduction("nanmean", lambda m: m.time(F.avg(m.valid_number)), result="floating", types=TIMED),
    Reduction("var", lambda m: m.unless_missing(_spread(m, m.number)), shifted=True, result="floating", types=NUMERIC),
    Reduction("nanvar", lambda m: _spread(m, m.valid_number), shifted=True, result="floating", types=NUMERIC),
    Reduction("std", lambda m: m.unless_missing(F.sqrt(_spread(m, m.number))), shifted=True, result="floating", types=NUMERIC),
    Reduction("nanstd", lambda m: F.sqrt(_spread(m, m.valid_number)), shifted=True, result="floating", types=NUMERIC),
    Reduction("max", lambda m: m.unless_missing(F.max(m.value))),
    Reduction("nanmax", lambda m: F.max(m.valid)),
    Reduction("min", lambda m: m.unless_missing(F.min(m.value))),
    Reduction("nanmin", lambda m: F.min(m.valid)),
    Reduction("argmax", _arg_max, -1, ordered=True, result="position"),
    Reduction("nanargmax", lambda m: F.coalesce(F.max_by(m.order, F.when(m.valid.isNotNull(), F.struct(m.valid, -m.order))), F.lit(-1)), -1, ordered=True, result="position"),
    Reduction("argmin", _arg_min, -1, ordered=True, result="position"),
    Reduction("nanargmin", lambda m: F.coalesce(F.min_by(m.order, F.when(m.valid.isNotNull(), F.struct(m.valid, m.order))), F.lit(-1)), -1, ordered=True, result="position"),
    Reduction("first", lambda m: F.min_by(m.value, m.order), ordered=True),
    Reduction("nanfirst", lambda m: F.min_by(m.valid, _valid_order(m)), ordered=True),
    Reduction("last", lambda m: F.max_by(m.value, m.order), ordered=True),
    Reduction("nanlast", lambda m: F.max_by(m.valid, _valid_order(m)), ordered=True),
    Reduction("any", lambda m: F.coalesce(F.bool_or(m.truth), F.lit(False)), False, result="bool", types=NUMERIC),
    Reduction("all", lambda m: F.coalesce(F.bool_and(m.truth), F.lit(False)), False, result="bool", types=NUMERIC),
    Reduction("median", lambda m: m.unless_missing(m.time(F.percentile(m.number, F.lit(0.5)))), result="floating", algebraic=False, types=TIMED),
    Reduction("nanmedian", lambda m: m.time(F.percentile(m.valid_number, F.lit(0.5))), result="floating", algebraic=False, types=TIMED),
    Reduction("quantile", lambda m: m.unless_missing(_quantile(m, m.number)), result="floating", algebraic=False, types=TIMED),
    Reduction("nanquantile", lambda m: _quantile(m, m.valid_number), result="floating", algebraic=False, types=TIMED),
    Reduction("mode", lambda m: m.unless_missing(F.mode(m.value, True)), algebraic=False),
    Reduction("nanmode", lambda m: F.mode(m.valid, True), algebraic=False),
    # for custom aggregations
    Reduction("sum_of_squares", lambda m: m.unless_missing(F.sum(m.number * m.number)), result="sum", types=NUMERIC),
    Reduction("nansum_of_squares", lambda m: F.coalesce(F.sum(m.valid_number * m.valid_number), F.lit(0)), result="sum", types=NUMERIC),
    Reduction("len", lambda m: F.count(F.lit(1)), 0, result="count"),
    Reduction("nanlen", lambda m: F.count(m.valid), 0, result="count"),
]
REDUCTIONS: dict[str, Reduction] = {r.name: r for r in _ALL}


def is_supported(kind: T.DataType, func: str, **options: Any) -> bool:
    """Whether a reduction exists for values of this type; quantiles only by linear interpolation."""
    r = REDUCTIONS.get(func)
    if r is None or options.get("method", "linear") != "linear":
        return False
    return r.types is None or isinstance(kind, r.types)


def result_cast(r: Reduction, m: Measure, found: Column, keep_float: bool = True) -> Column:
    """The result in the type it should have: single precision stays single, first and extreme values keep their type."""
    if keep_float and isinstance(m.kind, T.FloatType) and r.result in ("sum", "floating"):
        return F.transform(found, lambda x: x.cast("float")) if isinstance(m.q, list | tuple) and "quantile" in r.name else found.cast("float")
    if r.result == "count":
        return found.cast("bigint")
    if r.result == "sum" and is_floating(m.kind):
        return found.cast("double")
    return found
