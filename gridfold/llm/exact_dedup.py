"""Exact duplicates by a distributed content sort.

Sampled splitters range-partition the normalised text, an external sort inside each partition brings equal texts next to
each other, and neighbours are compared in full. Built from DataFrame functions alone.

The splitters are drawn from a bounded prefix of each text, so what the driver samples does not grow with the texts' length: the
first ``HEAD`` characters; where more rows share these than a quarter of a partition should hold, the characters up to ``MORE``
too; where even these are too common, a hash of all of them. What is too common then is one text with very many copies. Only
its rows are cut into runs, as many as its measured count needs, and the runs' first rows meet in a second, small sort, by the same
comparison of neighbours. All other texts have all their copies in one run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridfold.llm.common import materialise

#: Deleted before texts are compared: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
#: Characters of a splitter, and of one for texts whose first characters are too common.
HEAD, MORE = 64, 256
#: Rows that share a splitter's text are too many beyond this part of a partition.
PART = 4
KEY = ["head", "more", "digest", "salt"]


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), WHITE, F.coalesce(text, F.lit("")))


def _too_common(rows: DataFrame, partitions: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What too many rows share: (h0: hash of the head), (h0, h1: of the longer prefix), (h0, h1, h2: of the text; ``salts``: how many
    runs it needs). Each has at most ``PART`` times ``partitions`` rows, as each of its rows stands for that part of all."""
    norm = F.col("norm")
    hashes = rows.select(F.xxhash64(F.substring(norm, 1, HEAD)).alias("h0"), F.xxhash64(F.substring(norm, 1, MORE)).alias("h1"), F.xxhash64(norm).alias("h2"))
    counts = materialise(hashes.groupBy("h0", "h1", "h2").agg(F.count(F.lit(1)).alias("n")), "exact-dedup-counts")
    most = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // (PART * partitions))
    over = F.col("n") > most
    heads = counts.groupBy("h0").agg(F.sum("n").alias("n")).filter(over).select("h0")
    longer = counts.join(F.broadcast(heads), "h0", "left_semi").groupBy("h0", "h1").agg(F.sum("n").alias("n")).filter(over).select("h0", "h1")
    whole = counts.join(F.broadcast(longer), ["h0", "h1"], "left_semi").filter(over).select("h0", "h1", "h2", F.ceil(F.col("n") / most).alias("salts"))
    return tuple(F.broadcast(materialise(x, "exact-dedup-common")) for x in (heads.withColumn("deep", F.lit(True)), longer.withColumn("deeper", F.lit(True)), whole))


def content_sort(docs: DataFrame, id_col: str, text_col: str, partitions: int | None = None, rows_too: bool = True) -> tuple[DataFrame, bool]:
    """The rows (``row``, ``id``, ``n_points``, ``norm``) in the order of their texts, with ``new`` where a text differs from its
    neighbour before it and ``run``, the number of its run under its splitter ``KEY``; and whether any text is cut into several runs
    (then ``salted``). In a run, the row to be kept comes first. ``rows_too``: with all columns of ``docs`` in ``row``."""
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if rows_too else F.lit(None).cast("string")
    rows = docs.select(whole.alias("row"), F.col(f"`{id_col}`").alias("id"), F.char_length(text).alias("n_points"), normalised(F.col(f"`{text_col}`")).alias("norm"))
    heads, longer, copies = _too_common(rows, partitions)
    norm, deep, deeper = F.col("norm"), F.coalesce("deep", F.lit(False)), F.coalesce("deeper", F.lit(False))
    rows = rows.withColumn("h0", F.xxhash64(F.substring(norm, 1, HEAD))).join(heads, "h0", "left")
    rows = rows.withColumn("h1", F.when(deep, F.xxhash64(F.substring(norm, 1, MORE)))).join(longer, ["h0", "h1"], "left")
    rows = rows.withColumn("h2", F.when(deeper, F.xxhash64(norm))).join(copies, ["h0", "h1", "h2"], "left")
    dealt = F.xxhash64("id", F.spark_partition_id())  # copies of one row are cut apart too
    keyed = rows.select(
        "row", "id", "n_points", "norm", F.substring(norm, 1, HEAD).alias("head"), F.when(deep, F.substring(norm, HEAD + 1, MORE - HEAD)).otherwise("").alias("more"),
        F.coalesce("h2", F.lit(0).cast("long")).alias("digest"), F.coalesce(F.pmod(dealt, F.col("salts")), F.lit(0).cast("long")).alias("salt"), F.col("salts").isNotNull().alias("salted"),
    )
    ranged = keyed.drop("norm") if rows_too else keyed
    ranged = ranged.repartitionByRange(*KEY)
    if rows_too:  # the text is shuffled once and normalised again
        ranged = ranged.withColumn("norm", normalised(F.col("row").getField(text_col)))
    return _runs(ranged, KEY, ["id"]), not copies.isEmpty()


def _runs(rows: DataFrame, key: list[str], ties: list[str]) -> DataFrame:
    """``rows`` with ``new`` and ``run`` by the comparison of each text with its neighbour's."""
    order = W.partitionBy(*key).orderBy("norm", F.col("n_points").desc(), *[F.col(c).asc_nulls_last() for c in ties])
    marked = rows.withColumn("new", ~F.coalesce(F.lag("norm").over(order) == F.col("norm"), F.lit(False)))
    return marked.withColumn("run", F.sum(F.col("new").cast("long")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))


def _joined(leaders: DataFrame) -> DataFrame:
    """For the first rows (``uid``, key, norm, n_points, id, run_size) of the runs of texts that are cut: each run's uid with
    ``keep_id``, ``keep_uid`` and ``size`` of the whole group. Runs of one text are few: ``salts`` of them."""
    again = _runs(leaders, KEY[:3], ["id", "uid"])
    group = W.partitionBy(*KEY[:3], "run").orderBy(F.col("n_points").desc(), F.col("id").asc_nulls_last(), "uid").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return again.select("uid", F.first("id").over(group).alias("keep_id"), F.first("uid").over(group).alias("keep_uid"), F.sum("run_size").over(group).alias("size"))


def exact_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space (``WHITE``). Of equal texts the row with the most code
    points in its original text stays, then the smallest id; of rows that agree in both, one. Null texts count as empty
    and form a group with all texts of white space only; a null id comes after all others. An empty table gives none.
    ``partitions`` (by default those of a shuffle) says when a text's copies are too many for one run.
    """
    rows, cut = content_sort(docs.select(id_col, text_col), id_col, text_col, partitions, rows_too=False)
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    run = W.partitionBy(*KEY, "run").orderBy(F.col("new").desc()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    if not cut:
        slim = rows.select("id", "new", "run", *KEY, sha.alias("sha"))
        return slim.select(F.col("id").alias(id_col), F.first("id").over(run).alias("keep_id"), F.count(F.lit(1)).over(run).alias("group_size"), F.col("new").alias("kept"), F.col("sha").alias("text_sha256"))
    edge = F.when(F.col("salted") & F.col("new"), F.struct(*KEY[:3], "norm", "n_points"))
    slim = rows.select("id", "new", "run", "salted", *KEY, F.unhex(sha).alias("sha"), edge.alias("edge"), F.monotonically_increasing_id().alias("nth"))
    slim = slim.select("id", "new", "salted", "sha", "edge", F.first("id").over(run).alias("keep_id"), F.count(F.lit(1)).over(run).alias("run_size"), F.when(F.col("salted"), F.first("nth").over(run)).alias("uid"))
    slim = materialise(slim, "exact-dedup")
    groups = _joined(slim.filter("salted and new").select("uid", "id", "run_size", "edge.*")).withColumnRenamed("keep_id", "group_id").withColumnRenamed("uid", "of")
    whole = slim.join(groups, F.col("uid") == F.col("of"), "left")
    kept = F.col("new") & F.coalesce(F.col("uid") == F.col("keep_uid"), F.lit(True))
    keep = F.when(F.col("of").isNull(), F.col("keep_id")).otherwise(F.col("group_id"))
    return whole.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("size", "run_size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; ties and nulls as in :func:`exact_dedup_report`."""
    rows, cut = content_sort(docs, id_col, text_col, partitions)
    first = rows.filter("new")
    if cut:
        edge = F.when(F.col("salted"), F.struct(*KEY[:3], "norm", "n_points", "id"))
        first = materialise(first.select("row", edge.alias("edge"), F.monotonically_increasing_id().alias("uid")), "exact-dedup")
        groups = _joined(first.filter("edge is not null").select("uid", F.lit(1).alias("run_size"), "edge.*")).filter("uid <> keep_uid").select("uid")
        first = first.join(groups, "uid", "left_anti")
    return first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
"""
