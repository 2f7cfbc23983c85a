"""Documents to training sequences: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns all it kept; between stages the documents are written and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from gridfold.llm.common import materialise, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half."""
    model = toxicity.train(docs, toxicity.training_rows(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, score_col="_toxicity").filter(F.col("_toxicity") < 0.5).drop("_toxicity")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest doc_id."""
    return exact_dedup.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id."""
    return near_dedup.near_dedup(docs)


#: The targets of the mix, by source.
WEIGHTS = mixing.by_temperature(0.5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of a Pfair schedule of their sources by the square roots of their sizes."""
    return mixing.mix(docs, WEIGHTS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens, which follow the mixed order.

    Files do not keep the order of rows, so the schedule of the mix is made again from ids and sources.
    """
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    pieces = packing.tokenize(rows, packing.vocabulary(), "_row", keep=("doc_id", "source"))
    pieces = materialise(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    slots = mixing.schedule(pieces.filter("piece = 0").select("_row", "doc_id", "source"), WEIGHTS)
    pieces = pieces.drop("source").join(slots.select("_row", "slot", "in_block"), "_row")
    return packing.pack_in_order(pieces, ["slot", "in_block", "piece"]).drop("_row", "slot", "in_block")


STAGES = [("toxicity", without_toxic), ("exact dedup", without_copies), ("near dedup", without_near_copies), ("mixing", mixed), ("packing", packed)]

#: SQL cannot express compression distances, signatures or packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
