"""Grouped reductions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.functions.aggregates import REDUCTIONS, Measure, Reduction, is_supported, result_cast
from gridfold.functions.udaf import GroupAgg, HolisticAgg
from gridfold.plans.dense import cells, constant, densify
from gridfold.plans.keys import Key, as_key

UNSET: Any = object()
Func = str | Reduction | GroupAgg | HolisticAgg
#: Sums and products whose missing groups become NULL once a minimum count is asked for.
NULL_BELOW_COUNT = ("sum", "nansum", "prod", "nanprod")


def resolve(func: Func, kind: T.DataType, skipna: bool | None = None, **options: Any) -> Reduction | GroupAgg | HolisticAgg:
    """The reduction of a name; ``skipna`` picks the form of it that skips missing values or the one that does not."""
    if not isinstance(func, str):
        return func
    if skipna is not None:
        if func in ("any", "all", "count"):
            raise ValueError(f"skipna has no meaning for {func}")
        func = ("nan" if skipna else "") + func.removeprefix("nan")
    if func not in REDUCTIONS:
        raise ValueError(f"unknown reduction {func!r}")
    if func in ("quantile", "nanquantile") and options.get("q") is None:
        raise ValueError(f"{func} needs q")
    if not is_supported(kind, func):
        raise TypeError(f"{func} is not defined for {kind.simpleString()}")
    return REDUCTIONS[func]


def group_reduce(
    df: DataFrame,
    value: str | Sequence[str],
    *keys: str | Key,
    func: Func | Sequence[Func],
    order: str | None = None,
    keep_dims: Sequence[str] = (),
    fill_value: Any = UNSET,
    min_count: int | None = None,
    dtype: str | None = None,
    dense: bool | str = "auto",
    sort: bool | str = False,
    skipna: bool | None = None,
    q: float | Sequence[float] | None = None,
    ddof: int = 0,
    stable: bool = True,
    keep_float: bool = True,
    names: Sequence[str] | None = None,
    keep_metadata: bool = True,
) -> DataFrame:
    """Reduce ``value`` over the rows of each group: one row for each combination of ``keep_dims`` and labels of ``keys``.

    ``func`` is one reduction or several, and ``value`` one column or several, computed in one pass; results are columns
    ``<value>_<func>`` (or ``names``, all of the first value first). Rows
    with a missing label, or one outside a key's domain, belong to no group. ``order`` is a column of unique whole
    numbers, which positional reductions (first, last, arg...) need. With ``dense`` (by default when a key declares a domain or
    there are several keys) every cell of the product of the domains is there, absent ones with ``fill_value`` or the
    reduction's own; a product with more cells than ``OPTIONS.max_dense_cells`` raises ValueError. ``min_count``: groups with fewer valid values get the fill value; it is 1 by default where dims are
    kept or a fill value is given with a declared domain. ``q`` may be a list: one row for each, in a column ``quantile``.
    ``stable`` variances subtract the group's smallest value first, from a pass before. Results come in no order unless
    ``sort`` is True (by key) or "appearance" (needs ``order``).
    """
    ks, funcs = [as_key(k) for k in keys], list(func) if isinstance(func, list | tuple) else [func]
    values = [value] if isinstance(value, str) else list(value)
    fields = df.select(*values).schema.fields
    kinds = [f.dataType for f in (df.select(*[F.col(v).cast(dtype) for v in values]).schema.fields if dtype else fields)]
    plan = [(i, resolve(f, kind, skipna, q=q)) for i, kind in enumerate(kinds) for f in funcs]
    for _, r in plan:
        if getattr(r, "ordered", False) and order is None:
            raise ValueError(f"{r.name} depends on the order of the rows: give an order column")
    if sort == "appearance" and order is None:
        raise ValueError("the order of appearance needs an order column")
    outs = list(names) if names else [f"{values[i]}_{r.name}" for i, r in plan]
    dims, labels = [f"_d{i}" for i in range(len(keep_dims))], [f"_k{i}" for i in range(len(ks))]
    work = df.select(
        *[F.col(c).alias(d) for c, d in zip(keep_dims, dims, strict=True)], *[k.labels(df).alias(c) for k, c in zip(ks, labels, strict=True)],
        *[(F.col(v).cast(dtype) if dtype else F.col(v)).alias(f"_v{i}") for i, v in enumerate(values)], *([F.col(order).cast("bigint").alias("_o")] if order else []),
    )
    for k, c in zip(ks, labels, strict=True):
        work = k.restrict(work, c, df)
    by = dims + labels
    declared = any(k.declared for k in ks)
    filled = fill_value is not UNSET
    least = min_count if min_count is not None else int(bool(dims) or (filled and declared))

    levels = list(q) if isinstance(q, list | tuple) else q
    measures = [Measure(F.col(f"_v{i}"), kind, F.col("_o") if order else None, ddof, levels) for i, kind in enumerate(kinds)]
    if any(isinstance(r, HolisticAgg) for _, r in plan):
        found = _holistic(work, by, plan, outs)
    else:
        shifted = dict.fromkeys(i for i, r in plan if stable and getattr(r, "shifted", False))
        if shifted:
            work, shifted = _shifted(work, by, {i: measures[i] for i in shifted})
        first = [F.min("_o").alias("_first")] if sort == "appearance" else []
        counts = [F.count(m.valid).alias(f"_n{i}") for i, m in enumerate(measures)]
        found = work.groupBy(*by).agg(*counts, *first, *[_compute(r, shifted.get(i, measures[i]) if getattr(r, "shifted", False) else measures[i], dtype, keep_float).alias(o) for (i, r), o in zip(plan, outs, strict=True)])
    absents = {o: fill_value if filled else (None if least and r.name in NULL_BELOW_COUNT else r.absent) for (_, r), o in zip(plan, outs, strict=True)}
    if filled and any(isinstance(found.schema[o].dataType, T.IntegralType) and isinstance(fill_value, float) and fill_value != fill_value for o in outs):
        absents = dict.fromkeys(outs, None)  # NaN in a whole-number column: NULL
    if least > 0:
        found = found.withColumns({o: F.when(F.col(f"_n{i}") >= least, F.col(o)).otherwise(constant(absents[o], found.schema[o].dataType, q)) for (i, _), o in zip(plan, outs, strict=True)})
    if dense is True or (dense == "auto" and ks and (declared or len(ks) > 1)):
        extra = {"_first": None} if sort == "appearance" else {}
        found = densify(found, cells(ks, df, work, dims), by, absents | extra, q)
    if sort == "appearance":
        found = found.orderBy(F.col("_first").asc_nulls_last(), *by)
    elif sort:
        found = found.orderBy(*by)
    metadata = {o: fields[i].metadata if keep_metadata else {} for (i, _), o in zip(plan, outs, strict=True)}
    heads = [F.col(d).alias(c) for c, d in zip(keep_dims, dims, strict=True)] + [c for k, x in zip(ks, labels, strict=True) for c in k.outputs(F.col(x))]
    if isinstance(q, list | tuple):
        return _by_quantile(found, heads, outs, q)
    return found.select(*heads, *[F.col(o).alias(o, metadata=metadata[o]) if metadata[o] else F.col(o) for o in outs])


def _compute(r: Reduction | GroupAgg, m: Measure, dtype: str | None, keep_float: bool) -> Column:
    if isinstance(r, GroupAgg):
        seen = Measure(r.preprocess(m.value), m.kind, m.order, m.ddof, m.q) if r.preprocess else m
        found = r.finalize({name: part(seen) for name, part in r.parts.items()})
        return found.cast(r.dtype) if r.dtype else found
    found = result_cast(r, m, r.compute(m), keep_float)
    return found.cast(dtype) if dtype and r.result in ("same", "sum", "count") else found


def _shifted(work: DataFrame, by: list[str], measures: dict[int, Measure]) -> tuple[DataFrame, dict[int, Measure]]:
    """Rows with each value less the smallest valid one of the group, which leaves its variance as it is.

    Merged central moments in one pass are not precise enough: around 1e8 they are off by 5e-8, around 1e12 by 1e-4.
    """
    bases = [F.min(m.valid_number.cast("double")).alias(f"_base{i}") for i, m in measures.items()]
    if not by:
        work = work.withColumn("_one", F.lit(1)).join(work.agg(*bases).withColumn("_one", F.lit(1)), "_one").drop("_one")
    else:
        held = work.groupBy(*by).agg(*bases).withColumnsRenamed({c: f"_b{c}" for c in by})
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_b{c}")) for c in by])
        work = work.join(held, same).drop(*[f"_b{c}" for c in by])
    return work, {i: Measure(m.number.cast("double") - F.col(f"_base{i}"), T.FloatType() if isinstance(m.kind, T.FloatType) else T.DoubleType(), m.order, m.ddof, m.q) for i, m in measures.items()}


def _holistic(work: DataFrame, by: list[str], plan: list[tuple[int, Any]], outs: list[str]) -> DataFrame:
    if not all(isinstance(r, HolisticAgg) for _, r in plan):
        raise ValueError("holistic aggregations cannot be mixed with others in one call")
    several = sorted({i for i, _ in plan})
    schema = T.StructType([*work.select(*by).schema.fields, *[T.StructField(f"_n{i}", T.LongType()) for i in several]])
    for (_, r), o in zip(plan, outs, strict=True):
        schema = schema.add(o, r.dtype)

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        valid = [rows[f"_v{i}"].dropna() for i in several]
        return pd.DataFrame([[*key, *map(len, valid), *[r.function(valid[i]) for i, r in plan]]], columns=schema.names)

    return work.groupBy(*by).applyInPandas(whole, schema)


def _by_quantile(found: DataFrame, heads: list[Column], outs: list[str], q: Sequence[float]) -> DataFrame:
    """One row for each quantile; results that have none are repeated."""
    nested = [o for o in outs if isinstance(found.schema[o].dataType, T.ArrayType)]
    levels = found.select("*", F.posexplode(F.array(*[F.lit(float(x)) for x in q])).alias("_at", "quantile"))
    return levels.select(*heads, "quantile", *[F.get(F.col(o), F.col("_at")).alias(o) if o in nested else F.col(o) for o in outs])
