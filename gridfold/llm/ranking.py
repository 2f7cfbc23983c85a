"""Dense ranks within groups that may be larger than a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridfold.llm.common import materialise


def rank_within(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Each row as the struct ``row``, with its ``key`` and its ``rank`` (from 0) among the rows of that key, in the order of the
    partitions and of the rows inside them; and the table of ``key`` and its count ``n``.

    The rows are written once, with the partition they were in. Ranks are counted inside (key, partition) and moved on by
    the rows that earlier partitions hold of the key, so a key with most of the rows is spread like the rows themselves.
    A null key is a key.
    """
    numbered = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{key}`").alias("key"), F.monotonically_increasing_id().alias("nth"))
    laid = materialise(numbered, name).withColumn("part", F.shiftrightunsigned("nth", 33))
    parts = laid.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(F.col("key").alias("of"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("key", "part").orderBy("nth")
    ranked = laid.withColumn("inside", F.row_number().over(inside)).join(offsets, F.col("key").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    return ranked.select("row", "key", (F.col("before") + F.col("inside") - 1).alias("rank")), parts.groupBy("key").agg(F.sum("n").alias("n"))


def unpacked(names: list[str], but: tuple[str, ...] = ()) -> list[Column]:
    """The fields of ``row`` as columns."""
    return [F.col("row").getField(c).alias(c) for c in names if c not in but]
