"""Reductions of sparse arrays: stored cells, and an implicit value everywhere else."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions.missing import missing, present

SPARSE = ("sum", "nansum", "mean", "nanmean", "max", "nanmax", "min", "nanmin", "nanlen")


def sparse_reduce(cells: DataFrame, value: str, keys: Sequence[str], sizes: DataFrame, func: str, implicit: float | None = 0.0, size_column: str = "size") -> DataFrame:
    """One row for each row of ``sizes``: its keys and ``<value>_<func>``.

    ``cells`` are the stored cells with their labels; ``sizes`` says how many positions each group has in all. The positions that
    are not stored hold ``implicit`` (None or NaN: missing). Only stored cells are aggregated; the implicit value is folded
    in by the number of positions that lack one.
    """
    if func not in SPARSE:
        raise ValueError(f"{func!r} is not defined for sparse values; {', '.join(SPARSE)} are")
    kind = cells.select(value).schema[0].dataType
    v, valid = F.col(value), present(F.col(value), kind)
    void = implicit is None or math.isnan(implicit)
    fill = F.lit(None).cast("double") if void else F.lit(float(implicit))
    stored = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_stored"), F.count(valid).alias("_valid"), F.max(missing(v, kind)).alias("_bad"), F.sum(valid).alias("_sum"), F.min(valid).alias("_min"), F.max(valid).alias("_max")
    )
    same = [F.col(f"z.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    joined = sizes.alias("z").join(stored.alias("s"), same, "left")
    rest = F.col(f"z.{size_column}") - F.coalesce("_stored", F.lit(0))
    broken = F.coalesce("_bad", F.lit(False)) | (rest > 0) & F.lit(void)
    total = F.coalesce("_sum", F.lit(0.0)) + (F.lit(0.0) if void else rest * fill)
    n_valid = F.coalesce("_valid", F.lit(0)) + (F.lit(0) if void else rest)
    at_rest = F.when(rest > 0, fill)
    skipping = {
        "nansum": total,
        "nanmean": F.when(n_valid > 0, total / n_valid),
        "nanmax": F.greatest("_max", at_rest),
        "nanmin": F.least("_min", at_rest),
        "nanlen": n_valid.cast("bigint"),
    }
    found: Column = skipping[func] if func in skipping else F.when(~broken, skipping[f"nan{func}"])
    return joined.select(*[F.col(f"z.{k}").alias(k) for k in keys], found.alias(f"{value}_{func}"))
