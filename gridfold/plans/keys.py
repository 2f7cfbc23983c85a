"""Group keys: how rows get a label, and which labels there should be.

A key makes one column of codes or labels (NULL where a row belongs to no group, which drops it from reductions), a domain if
it declares one, and output columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.functions.missing import present


#: Expected labels up to so many become a filter that scans can push down; more are a semi-join.
PUSHED_LABELS = 1000


@dataclass
class Key:
    column: str
    name: str | None = field(default=None, kw_only=True)

    @property
    def out(self) -> str:
        return self.name or self.column

    @property
    def declared(self) -> bool:
        """Whether the key has a domain of its own."""
        return False

    def labels(self, df: DataFrame) -> Column:
        return present(F.col(self.column), df.select(self.column).schema[0].dataType)

    def domain(self, df: DataFrame) -> DataFrame | None:
        """The declared labels as a column ``label``, in order."""
        return None

    def restrict(self, work: DataFrame, column: str, df: DataFrame) -> DataFrame:
        """``work`` without the rows whose label in ``column`` is missing or not in the domain."""
        return work.filter(F.col(column).isNotNull())

    def outputs(self, label: Column) -> list[Column]:
        return [label.alias(self.out)]


@dataclass
class Labels(Key):
    """Labels as they are; with ``expected``, only those, all of them."""

    expected: Sequence[Any] | DataFrame | None = None

    @property
    def declared(self) -> bool:
        return self.expected is not None

    def domain(self, df: DataFrame) -> DataFrame | None:
        if self.expected is None:
            return None
        kind = df.select(self.column).schema[0].dataType
        if isinstance(self.expected, DataFrame):
            return self.expected.toDF("label").filter(F.col("label").isNotNull()).distinct()
        schema = T.StructType([T.StructField("label", kind)])
        unique = list(dict.fromkeys(x for x in self.expected if x is not None and x == x))
        return df.sparkSession.createDataFrame([(x,) for x in unique], schema)


    def restrict(self, work: DataFrame, column: str, df: DataFrame) -> DataFrame:
        work = super().restrict(work, column, df)
        if self.expected is None:
            return work
        if not isinstance(self.expected, DataFrame) and len(self.expected) <= PUSHED_LABELS:
            return work.filter(F.col(column).isin([x for x in self.expected if x is not None and x == x]))
        return work.join(self.domain(df).select(F.col("label").alias(column)), column, "left_semi")


@dataclass
class Codes(Key):
    """Labels that are codes from 0 to ``n`` - 1 already; others belong to no group."""

    n: int = 0

    @property
    def declared(self) -> bool:
        return True

    def labels(self, df: DataFrame) -> Column:
        c = F.col(self.column)
        return F.when(c.between(0, self.n - 1), c.cast("bigint"))

    def domain(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.range(self.n).toDF("label")


def bin_code(value: Column, edges: Column, closed: str) -> Column:
    """The number of the bin between consecutive ``edges`` (a rising array), or NULL outside."""
    if closed not in ("right", "left"):
        raise NotImplementedError(f"bins closed on {closed!r}; only 'right' and 'left' are")
    below = F.size(F.filter(edges, lambda e: (e < value) if closed == "right" else (e <= value))) - 1
    return F.when(value.isNotNull() & below.between(0, F.size(edges) - 2), below)


@dataclass
class Bins(Key):
    """Contiguous bins between rising ``edges``, numbers or times, closed on the right, (l, r], or on the left, [l, r). Output
    columns are ``<name>_left`` and ``<name>_right``."""

    edges: Sequence[Any] = field(default_factory=tuple)
    closed: str = "right"

    def __post_init__(self) -> None:
        if isinstance(self.edges, int):
            raise ValueError("bins need edges, not a number of bins")
        if self.closed not in ("right", "left"):
            raise NotImplementedError(f"bins closed on {self.closed!r}; only 'right' and 'left' are")
        if len(self.edges) < 2 or any(a >= b for a, b in zip(self.edges, self.edges[1:], strict=False)):
            raise ValueError("edges must be at least two and rise")

    @property
    def declared(self) -> bool:
        return True

    def _edges(self) -> Column:
        return F.array(*[F.lit(e) for e in self.edges])

    def labels(self, df: DataFrame) -> Column:
        kind = df.select(self.column).schema[0].dataType
        value = present(F.col(self.column), kind)
        edges = self._edges()
        if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
            edges = F.transform(edges, lambda e: e.cast(kind))
        return bin_code(value, edges, self.closed)

    def domain(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.range(len(self.edges) - 1).select(F.col("id").cast("int").alias("label"))

    def outputs(self, label: Column) -> list[Column]:
        edges = self._edges()
        return [F.get(edges, label).alias(f"{self.out}_left"), F.get(edges, label + 1).alias(f"{self.out}_right")]


@dataclass
class RowBins(Key):
    """Bins whose edges are in the rows: ``edges_column`` holds a rising array, for example joined on a looped dimension. The
    output column is the number of the bin; with ``n`` the bins 0 to ``n`` - 1 are all there."""

    edges_column: str = "edges"
    closed: str = "right"
    n: int | None = None

    @property
    def declared(self) -> bool:
        return self.n is not None

    def labels(self, df: DataFrame) -> Column:
        code = bin_code(super().labels(df), F.col(self.edges_column), self.closed)
        return code if self.n is None else F.when(code < self.n, code)

    def domain(self, df: DataFrame) -> DataFrame | None:
        return None if self.n is None else df.sparkSession.range(self.n).select(F.col("id").cast("int").alias("label"))


@dataclass
class Resample(Key):
    """Time buckets: ``every`` is a unit of ``date_trunc`` ("day", "month") or an interval ("5 days"), counted from ``start``.
    With ``fill_gaps``, buckets between the first and the last (or ``start`` and ``end``) that have no rows are there too."""

    every: str = "day"
    start: str | None = None
    end: str | None = None
    fill_gaps: bool = True

    @property
    def declared(self) -> bool:
        return self.fill_gaps

    @property
    def _truncates(self) -> bool:
        return not any(ch.isdigit() for ch in self.every)

    def _step(self) -> Column:
        return F.expr(f"INTERVAL {'1 ' if self._truncates else ''}{self.every}")

    def _micros(self) -> Column:
        """The length of an interval bucket."""
        at = F.timestamp_micros(F.lit(0))
        return F.unix_micros(at + self._step())

    def labels(self, df: DataFrame) -> Column:
        kind = df.select(self.column).schema[0].dataType
        c = F.col(self.column)
        if self._truncates:
            return F.date_trunc(self.every, c).cast(kind)
        if isinstance(kind, T.TimestampNTZType):
            c = F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone())
        micros, start = F.unix_micros(c.cast("timestamp")), F.unix_micros(F.to_timestamp(F.lit(self.start or "1970-01-01")))
        begun = F.timestamp_micros(start + F.floor((micros - start) / self._micros()) * self._micros())
        return F.from_utc_timestamp(begun, F.current_timezone()).cast(kind) if isinstance(kind, T.TimestampNTZType) else begun.cast(kind)

    def domain(self, df: DataFrame) -> DataFrame | None:
        if not self.fill_gaps:
            return None
        kind = df.select(self.column).schema[0].dataType
        if self.start and self.end:
            ends = df.sparkSession.range(1).select(F.lit(self.start).cast(kind).alias("a"), F.lit(self.end).cast(kind).alias("b"))
        else:
            ends = df.select(self.labels(df).alias("l")).agg(F.min("l").alias("a"), F.max("l").alias("b"))
            if self.start:
                ends = ends.withColumn("a", F.lit(self.start).cast(kind))
            if self.end:
                ends = ends.withColumn("b", F.lit(self.end).cast(kind))
        return ends.filter("a <= b").select(F.explode(F.sequence("a", "b", self._step())).alias("label")).select(F.col("label").cast(kind))


PARTS = {
    "year": (F.year, None), "quarter": (F.quarter, (1, 4)), "month": (F.month, (1, 12)), "week": (F.weekofyear, (1, 53)),
    "dayofyear": (F.dayofyear, (1, 366)), "day": (F.dayofmonth, (1, 31)), "weekday": (F.weekday, (0, 6)), "hour": (F.hour, (0, 23)), "minute": (F.minute, (0, 59)),
}


@dataclass
class DatePart(Key):
    """A part of a time, as in a climatology; with ``full``, all values it can take are there."""

    part: str = "month"
    full: bool = False

    @property
    def declared(self) -> bool:
        return self.full and PARTS[self.part][1] is not None

    def labels(self, df: DataFrame) -> Column:
        return PARTS[self.part][0](F.col(self.column)).cast("int")

    def domain(self, df: DataFrame) -> DataFrame | None:
        if not self.declared:
            return None
        low, high = PARTS[self.part][1]
        return df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("label"))


@dataclass
class Tuples(Key):
    """Several columns as one key of tuples that occur; a tuple with a missing part is no group."""

    parts: Sequence[str] = field(default_factory=tuple)

    def labels(self, df: DataFrame) -> Column:
        kinds = df.select(*self.parts).schema
        whole = [present(F.col(p), kinds[p].dataType) for p in self.parts]
        filled = F.lit(True)
        for w in whole:
            filled = filled & w.isNotNull()
        return F.when(filled, F.struct(*[w.alias(p) for w, p in zip(whole, self.parts, strict=True)]))

    def outputs(self, label: Column) -> list[Column]:
        return [label[p].alias(p) for p in self.parts]


def as_key(key: str | Key) -> Key:
    return Labels(key) if isinstance(key, str) else key


def overlapping(df: DataFrame, *labels: Column | str, into: str = "label") -> DataFrame:
    """One row for each of a row's labels: groups may overlap. Missing labels give none."""
    each = F.array(*[F.col(x) if isinstance(x, str) else x for x in labels])
    return df.withColumn(into, F.explode(F.filter(each, lambda x: x.isNotNull())))


def with_labels(df: DataFrame, labels: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with the labels of a table that lacks some of their dimensions, joined on those it has. The plan broadcasts a table
    that Spark knows to be small, and shuffles both sides otherwise."""
    return df.join(labels, list(on), "left")


