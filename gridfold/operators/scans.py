"""Grouped scans: results for every row from the rows of its group up to it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.functions.aggregates import Measure
from gridfold.functions.missing import missing
from gridfold.functions.udaf import GroupScan, PandasScan
from gridfold.plans.keys import Key, as_key
from gridfold.plans.stable import stable

SCANS = ("cumsum", "nancumsum", "ffill", "bfill")


def group_scan(df: DataFrame, value: str, *keys: str | Key, func: str | GroupScan | PandasScan, order: str | Sequence[str], name: str | None = None, partitioned: bool = False) -> DataFrame:
    """``df`` with one more column, ``<value>_<func>`` or ``name``: the scan of ``value`` in its group, in the order of ``order``.

    ``cumsum`` is NULL from the first missing value on, ``nancumsum`` counts missing values as 0, ``ffill`` and ``bfill`` are the
    last valid value up to, and the first from, a row. Sums of timestamps, as microseconds, are timestamps again, those of intervals
    are intervals, and those of booleans counts. Rows with a missing label are scanned as one group. A window holds
    a group in one task; with ``partitioned``, groups are cut into ranges, scanned in parallel, and joined up by what the
    ranges before hold, so a group may be larger than a task. ``order`` should tell the rows of a group apart.
    """
    ks = [as_key(k) for k in keys]
    kind = df.select(value).schema[0].dataType
    out = name or f"{value}_{func if isinstance(func, str) else func.name}"
    labels = [f"_k{i}" for i in range(len(ks))]
    orders = [F.col(order)] if isinstance(order, str) else [F.col(c) for c in order]
    work = df.withColumns({c: k.labels(df) for k, c in zip(ks, labels, strict=True)}) if ks else df
    if isinstance(func, PandasScan):
        return _in_pandas(work, value, labels, order, func, out).drop(*labels)
    if isinstance(func, str) and func not in SCANS:
        raise ValueError(f"unknown scan {func!r}")
    m = Measure(F.col(value), kind)
    if partitioned:
        if not isinstance(func, str):
            raise ValueError("a custom scan cannot be partitioned")
        return _partitioned(work, m, labels, orders, func, out).drop(*labels)
    scan = W.partitionBy(*labels).orderBy(*orders)
    if isinstance(func, GroupScan):
        frame = scan.rowsBetween(0, W.unboundedFollowing) if func.reverse else scan.rowsBetween(W.unboundedPreceding, 0)
        return work.withColumn(out, func.expression(m, frame)).drop(*labels)
    return work.withColumn(out, _restored(m, _windowed(m, scan, func), func)).drop(*labels)


def _zero(m: Measure) -> Column:
    return F.lit(timedelta(0)) if isinstance(m.kind, T.DayTimeIntervalType) else F.lit(0)


def _restored(m: Measure, found: Column, func: str) -> Column:
    return m.time(found) if func in ("cumsum", "nancumsum") else found


def _windowed(m: Measure, scan, func: str) -> Column:
    before = scan.rowsBetween(W.unboundedPreceding, 0)
    if func == "bfill":
        return F.first(m.valid, ignorenulls=True).over(scan.rowsBetween(0, W.unboundedFollowing))
    if func == "ffill":
        return F.last(m.valid, ignorenulls=True).over(before)
    if func == "nancumsum":
        return F.coalesce(F.sum(m.valid_number).over(before), _zero(m))
    return F.when(~F.max(missing(m.value, m.kind)).over(before), F.sum(m.number).over(before))


def _partitioned(work: DataFrame, m: Measure, labels: list[str], orders: list[Column], func: str, out: str) -> DataFrame:
    """Scan each range of a group by itself, then add what the ranges on its near side hold."""
    ranged = work.repartitionByRange(*[F.col(c) for c in labels], *orders).withColumn("_part", F.spark_partition_id())
    ranged = stable(ranged)
    own = W.partitionBy(*labels, "_part").orderBy(*orders)
    parts = ranged.groupBy(*labels, "_part").agg(
        F.sum(m.valid_number).alias("_sum"), F.max(missing(m.value, m.kind)).alias("_bad"),
        F.max_by(m.valid, F.when(m.valid.isNotNull(), F.struct(*orders))).alias("_last"), F.min_by(m.valid, F.when(m.valid.isNotNull(), F.struct(*orders))).alias("_head"),
    )
    by_part = W.partitionBy(*labels).orderBy("_part")
    before, after = by_part.rowsBetween(W.unboundedPreceding, -1), by_part.rowsBetween(1, W.unboundedFollowing)
    held = parts.select(
        *[F.col(c).alias(f"{c}_of") for c in labels], F.col("_part").alias("_of"), F.sum("_sum").over(before).alias("_sum"), F.coalesce(F.max("_bad").over(before), F.lit(False)).alias("_bad"),
        F.last("_last", True).over(before).alias("_last"), F.first("_head", True).over(after).alias("_head"),
    )
    same = F.col("_part") == F.col("_of")
    for c in labels:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    joined = ranged.withColumn("_own", _windowed(m, own, func)).join(held, same)
    if func == "ffill":
        whole = F.coalesce("_own", "_last")
    elif func == "bfill":
        whole = F.coalesce("_own", "_head")
    elif func == "nancumsum":
        whole = F.col("_own") + F.coalesce("_sum", _zero(m))
    else:
        whole = F.when(~F.col("_bad"), F.col("_own") + F.coalesce("_sum", _zero(m)))
    return joined.withColumn(out, _restored(m, whole, func)).drop("_own", "_sum", "_bad", "_last", "_head", "_part", "_of", *[f"{c}_of" for c in labels])


def _in_pandas(work: DataFrame, value: str, labels: list[str], order: str | Sequence[str], func: PandasScan, out: str) -> DataFrame:
    schema = T.StructType([*work.schema.fields]).add(out, func.dtype)
    by = [order] if isinstance(order, str) else list(order)

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(by)
        return rows.assign(**{out: func.function(rows[value]).to_numpy()})

    return work.groupBy(*labels).applyInPandas(whole, schema)
