"""Layouts: where the rows of each label are, and how to place them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridfold.plans.contained import contained
from gridfold.plans.stable import stable

#: Share of a label's chunks that must be among another's for the two to be merged.
CONTAINMENT = 0.75


def blockwise(df: DataFrame, *keys: str, partitions: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Rows placed so that every label is whole in one partition, labels in ranges; later groupings by these keys need no
    further exchange. A label with more rows than a partition can hold should not be placed so."""
    placed = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return placed.sortWithinPartitions(*keys, *order)


def chunk_starts(df: DataFrame, order: str, label: str, starts: Sequence[Any], chunk: str = "chunk", every: int | None = None) -> DataFrame:
    """``df`` with the number of its chunk: one begins, in the order of ``order``, at each row whose label is in ``starts`` (and, with
    ``every``, after as many rows in a chunk). Counted in ranges of the order, not in one task."""
    ranged = stable(df.withColumn("_begins", F.col(label).isin(list(starts)).cast("long")).repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # over one row for each partition
    held = ranged.groupBy("_part").agg(F.sum("_begins").alias("_n")).select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    counted = ranged.withColumn("_in", F.coalesce(F.sum("_begins").over(inside), F.lit(0))).join(held, F.col("_part") == F.col("_of"))
    counted = counted.withColumn(chunk, F.col("_before") + F.col("_in")).drop("_begins", "_part", "_of", "_before", "_in")
    if every is None:
        return counted
    place = F.row_number().over(W.partitionBy(chunk).orderBy(order)) - 1
    return counted.withColumn(chunk, F.struct(F.col(chunk).alias("start"), F.floor(place / every).alias("nth")))


def cohorts(df: DataFrame, label: str, chunk: str) -> DataFrame:
    """``labels`` that occur in exactly the same ``chunks``, one row for each such set."""
    held = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.array_sort(F.collect_set(chunk)).alias("chunks"))
    return held.groupBy("chunks").agg(F.array_sort(F.collect_list(label)).alias("labels")).select("labels", "chunks")


def containment(df: DataFrame, label: str, chunk: str, least: float = CONTAINMENT) -> DataFrame:
    """Pairs of labels of which at least the share ``least`` of the chunks of the first are chunks of the second."""
    return contained(df, label, chunk, least)


def merged_cohorts(df: DataFrame, label: str, chunk: str, least: float = CONTAINMENT) -> DataFrame:
    """Cohorts with each label put to the one of most chunks that contains it (of such, the one that holds most of its chunks,
    then the least label): ``cohort`` (a label) and ``labels``."""
    pairs = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(chunk).alias("chunk")).distinct()
    sizes = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    into = containment(df, label, chunk, least).join(sizes.select(F.col("label").alias("within"), F.col("n").alias("n_within")), "within").join(sizes, "label")
    larger = into.filter((F.col("n_within") > F.col("n")) | (F.col("n_within") == F.col("n")) & (F.col("within") < F.col("label")))
    first = W.partitionBy("label").orderBy(F.desc("n_within"), F.desc("containment"), "within")
    best = larger.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").select("label", F.col("within").alias("cohort"))
    told = sizes.join(best, "label", "left").select("label", F.coalesce("cohort", "label").alias("cohort"))
    top = told.select(F.col("label").alias("cohort"), F.col("cohort").alias("above"))
    told = told.join(top, "cohort", "left").select("label", F.coalesce("above", "cohort").alias("cohort"))
    return told.groupBy("cohort").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def strategy(df: DataFrame, label: str, chunk: str) -> DataFrame:
    """One row: how many labels and chunks there are, how dense labels are in chunks, and the layout that follows: "blockwise"
    where each label is in one chunk, "cohorts" where labels share few chunks, else "map-reduce"."""
    pairs = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(chunk).alias("chunk")).distinct()
    by_label = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sums = by_label.agg(F.count(F.lit(1)).alias("n_labels"), F.sum("n").alias("n_pairs"), F.max("n").alias("most_chunks"))
    n_chunks = pairs.agg(F.countDistinct("chunk").alias("n_chunks"))
    density = F.col("n_pairs") / (F.col("n_labels") * F.col("n_chunks"))
    kind = F.when(F.col("most_chunks") <= 1, "blockwise").when((F.col("n_chunks") > 1) & (density < 0.4), "cohorts").otherwise("map-reduce")
    return sums.withColumn("_one", F.lit(1)).join(n_chunks.withColumn("_one", F.lit(1)), "_one").select("n_labels", "n_chunks", "most_chunks", density.alias("density"), kind.alias("strategy"))


def remember(df: DataFrame) -> DataFrame:
    """Keep a layout for the reductions that follow; ``unpersist`` it when they are done."""
    return df.persist()
