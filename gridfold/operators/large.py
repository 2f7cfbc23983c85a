"""Holistic reductions of groups too large for one aggregation buffer.

The built-in percentile and mode keep a group's distinct values in a buffer. Here quantiles come from ranks: rows are
range-partitioned and sorted by group and value, ranks are counted inside the ranges and moved on by the counts of the ranges
before, and only the rows at the ranks next to a quantile are gathered. Modes come from counts by group and value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridfold.functions.missing import missing, present
from gridfold.plans.keys import Key, as_key
from gridfold.plans.stable import stable


def _rows(df: DataFrame, value: str, keys: Sequence[Key]) -> tuple[DataFrame, list[str], DataFrame]:
    """Rows with labels and valid values; the labels' names; and which groups have missing values."""
    kind = df.select(value).schema[0].dataType
    labels = [f"_k{i}" for i in range(len(keys))]
    work = df.select(*[k.labels(df).alias(c) for k, c in zip(keys, labels, strict=True)], present(F.col(value), kind).alias("_v"), missing(F.col(value), kind).alias("_bad"))
    for k, c in zip(keys, labels, strict=True):
        work = k.restrict(work, c, df)
    return work, labels, work.groupBy(*labels).agg(F.count("_v").alias("_n"), F.max("_bad").alias("_any_bad"))


def group_quantile(df: DataFrame, value: str, *keys: str | Key, q: float | Sequence[float], skipna: bool = True, name: str | None = None) -> DataFrame:
    """Exact quantiles by linear interpolation: one row for each group, or for each of several ``q`` (column ``quantile``). Groups
    without valid values, or with missing ones where these are not skipped, get NULL."""
    ks, levels = [as_key(k) for k in keys], [float(x) for x in (q if isinstance(q, list | tuple) else [q])]
    out = name or f"{value}_{'nan' * skipna}quantile"
    work, labels, groups = _rows(df, value, ks)
    ranged = stable(work.filter(F.col("_v").isNotNull()).repartitionByRange(*labels, "_v").withColumn("_part", F.spark_partition_id()).select(*labels, "_v", "_part"))
    before = W.partitionBy(*labels).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    held = ranged.groupBy(*labels, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    held = held.select(*[F.col(c).alias(f"{c}_of") for c in labels], F.col("_part").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_of")
    for c in labels:
        same = same & (F.col(c) == F.col(f"{c}_of"))
    inside = W.partitionBy(*labels, "_part").orderBy("_v")
    ranked = ranged.withColumn("_in", F.row_number().over(inside) - 1).join(held, same).select(*labels, (F.col("_before") + F.col("_in")).alias("_rank"), "_v")
    wanted = groups.select(*[F.col(c).alias(f"{c}_w") for c in labels], "_n", "_any_bad", F.explode(F.array(*map(F.lit, levels))).alias("_q")).withColumn("_at", F.col("_q") * (F.col("_n") - 1))
    places = wanted.withColumn("_place", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    hit = (F.col("_place") == F.col("_rank"))
    for c in labels:
        hit = hit & (F.col(f"{c}_w") == F.col(c))
    by = [f"{c}_w" for c in labels]
    joined = places.join(ranked, hit, "left").groupBy(*by, "_q", "_at", "_any_bad").agg(F.min_by("_v", "_place").alias("_low"), F.max_by("_v", "_place").alias("_high"))
    found = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))
    result = found if skipna else F.when(~F.col("_any_bad"), found)
    heads = [c for k, x in zip(ks, by, strict=True) for c in k.outputs(F.col(x))]
    return joined.select(*heads, *([F.col("_q").alias("quantile")] if isinstance(q, list | tuple) else []), result.alias(out))


def group_mode(df: DataFrame, value: str, *keys: str | Key, skipna: bool = True, name: str | None = None) -> DataFrame:
    """The most frequent value of each group, the smallest of several; NULL as in :func:`group_quantile`."""
    ks = [as_key(k) for k in keys]
    work, labels, _ = _rows(df, value, ks)
    counted = work.groupBy(*labels, "_v").agg(F.count(F.lit(1)).alias("_n"), F.max("_bad").alias("_bad"))
    best = F.min_by("_v", F.when(F.col("_v").isNotNull(), F.struct(-F.col("_n"), F.col("_v"))))
    found = counted.groupBy(*labels).agg((best if skipna else F.when(~F.max("_bad"), best)).alias("_mode"))
    return found.select(*[c for k, x in zip(ks, labels, strict=True) for c in k.outputs(F.col(x))], F.col("_mode").alias(name or f"{value}_{'nan' * skipna}mode"))
