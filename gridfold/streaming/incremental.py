"""Reductions of a stream: the algebraic ones, updated as rows come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfold.functions.aggregates import Measure, result_cast
from gridfold.operators.reduce import resolve
from gridfold.plans.keys import Key, as_key


def stream_reduce(stream: DataFrame, value: str, *keys: str | Key, func: str | Sequence[str], time: str | None = None, window: str | None = None, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Reductions over the groups of a stream, by event-time ``window`` if given (columns ``start`` and ``end``), with rows up
    to ``late`` after the latest. Domains are not made dense, and positional and holistic reductions are refused."""
    ks, kind = [as_key(k) for k in keys], stream.select(value).schema[0].dataType
    rs = [resolve(f, kind) for f in ([func] if isinstance(func, str) else func)]
    if refused := [r.name for r in rs if not r.algebraic or r.ordered]:
        raise ValueError(f"not for streams: {', '.join(refused)}")
    labels = [k.labels(stream).alias(f"_k{i}") for i, k in enumerate(ks)]
    rows = stream.select(*labels, F.col(value).alias("_v"), *([F.col(time)] if time else []))
    for i, k in enumerate(ks):
        rows = k.restrict(rows, f"_k{i}", stream)
    by = [f"_k{i}" for i in range(len(ks))]
    if window:
        rows = rows.withWatermark(time, late)
        by = [F.window(time, window, slide).alias("_w"), *by]
    m = Measure(F.col("_v"), kind)
    found = rows.groupBy(*by).agg(*[result_cast(r, m, r.compute(m)).alias(f"{value}_{r.name}") for r in rs])
    heads = [F.col("_w.start").alias("start"), F.col("_w.end").alias("end")] if window else []
    return found.select(*heads, *[c for i, k in enumerate(ks) for c in k.outputs(F.col(f"_k{i}"))], *[f"{value}_{r.name}" for r in rs])
