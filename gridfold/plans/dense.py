"""Dense results: every cell of the product of the keys' domains, with fill values where no rows are.

The aggregate itself is sparse. Cells are numbers of a range, taken apart into one label number for each key, so the product
is made in parallel and without a join of the domains with each other; the aggregate is joined to it once, at the end.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod
from typing import NoReturn

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.options import OPTIONS
from gridfold.plans.keys import Key


def domain_of(key: Key, at: int, source: DataFrame, work: DataFrame) -> DataFrame:
    """The labels of a key, declared or found, as a column ``label``."""
    declared = key.domain(source)
    return declared if declared is not None else work.select(F.col(f"_k{at}").alias("label")).distinct()


def cells(keys: Sequence[Key], source: DataFrame, work: DataFrame, dims: Sequence[str]) -> DataFrame:
    """A row for each cell, with columns ``_k0`` ... and those of ``dims``; ValueError where there would be too many, those of kept
    dims counted too."""
    spark = source.sparkSession
    if len(keys) == 1 and not dims:
        return domain_of(keys[0], 0, source, work).select(F.col("label").alias("_k0"))
    tables = []
    for i, key in enumerate(keys):
        found = domain_of(key, i, source, work).orderBy("label").limit(OPTIONS.max_domain + 1)
        schema = T.StructType([T.StructField(f"_c{i}", T.LongType()), T.StructField(f"_k{i}", found.schema[0].dataType)])
        labels = [r["label"] for r in found.collect()]  # at most the option
        if len(labels) > OPTIONS.max_domain:
            _refuse(f"key {key.out} has more than {OPTIONS.max_domain} labels")
        tables.append((spark.createDataFrame(list(enumerate(labels)), schema), len(labels)))
    sizes = [n for _, n in tables]
    total = prod(sizes)
    if total > OPTIONS.max_dense_cells:
        _refuse(f"{total} cells")
    if not total:
        return work.select(*dims, *[f"_k{i}" for i in range(len(keys))]).limit(0)
    if dims:
        most = OPTIONS.max_dense_cells // total
        if work.select(*dims).distinct().limit(most + 1).count() > most:
            _refuse(f"{total} cells for each of more than {most} places")
        numbered = work.select(*dims).distinct().withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long"))))
    else:
        numbered = spark.range(total).select(F.col("id").alias("_cell"))
    below = total
    for i, (table, n) in enumerate(tables):
        below //= n
        numbered = numbered.withColumn(f"_c{i}", F.floor(F.col("_cell") / below) % n)
    for i, (table, n) in enumerate(tables):
        numbered = numbered.join(F.broadcast(table) if n <= OPTIONS.broadcast_domain else table, f"_c{i}").drop(f"_c{i}")
    return numbered.drop("_cell")


def _refuse(why: str) -> NoReturn:
    raise ValueError(f"the dense result is too large: {why}; use dense=False or raise the option")


def constant(fill: object, kind: T.DataType, q: object = None) -> Column:
    """A fill value as a column of a type; for several quantiles, as many of it."""
    if isinstance(kind, T.ArrayType) and isinstance(q, list | tuple) and fill is not None:
        return F.array(*[F.lit(fill).cast(kind.elementType) for _ in q])
    return F.lit(fill).cast(kind)


def densify(found: DataFrame, grid: DataFrame, on: Sequence[str], fills: dict[str, object], q: object = None) -> DataFrame:
    """``found`` with all the cells of ``grid``; absent ones get ``fills``."""
    marked = found.withColumn("_there", F.lit(True))
    same = None
    for c in on:
        match = F.col(f"g.{c}").eqNullSafe(F.col(f"f.{c}")) if c.startswith("_d") else F.col(f"g.{c}") == F.col(f"f.{c}")
        same = match if same is None else same & match
    joined = grid.alias("g").join(marked.alias("f"), same, "left")
    kinds = {f.name: f.dataType for f in found.schema}
    values = [
        (F.when(F.col("f._there"), F.col(f"f.{c}")).otherwise(constant(fill, kinds[c], q)) if fill is not None else F.col(f"f.{c}")).alias(c)
        for c, fill in fills.items()
    ]
    return joined.select(*[F.col(f"g.{c}").alias(c) for c in on], *values)
