"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm import chat, exact_dedup, html_text, mixing, near_dedup, packing, pii, pivot_search, quality, toxicity
from gridfold.llm.common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = chat.lines_of(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text")
    ranked = chat.ranked_lines(lines, "chat")
    model = chat.train(ranked.filter(F.crc32(F.col("conv").cast("string")) % 5 != 0))
    held = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 5 == 0, F.lit(False))
    return chat.format_chat(ranked, model).withColumn("held_out", held)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").withColumn("grade", quality.graded(F.col("quality"), F.col("toxic")))
    model = quality.train(docs, labels.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), n_grades=3)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return quality.score(docs, model, tail=1).select("doc_id", held.alias("held_out"), "expected_grade", "tail_probability", "grade")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").filter(pivot_search.usable(F.col("embedding")))
    vectors = vectors.select("vec_id", pivot_search.quantised(F.col("embedding")).alias("embedding"))
    found = pivot_search.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)
    return found.withColumn("score", F.col("score").cast("long"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.schedule(docs, mixing.by_temperature(0.5))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, toxicity.training_rows(table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digest = F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *map(of, pii.KINDS), digest, pii.written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_report(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), packing.vocabulary())
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_quality": op3_quality,
    "op4_topk_search": op4_topk_search,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_html_text": op10_html_text,
}

ORACLE_SQL: dict[str, str] = {
    "op4_topk_search": pivot_search.OP4_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
}
