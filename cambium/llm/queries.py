"""The p-queries of the problems on text, and SQL for those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cambium.llm import docpairs, handwritten, leakage, packing, splitting
from cambium.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pairs(spark, d).select("doc_id", "qname").distinct()


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.function_pairs(table(spark, d, "documents"), table(spark, d, "files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_reasons(spark, d).select("repo", "path")


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.machine_made(table(spark, d, "documents"))


def p5_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many files each kind of evidence finds, and which none but conventions do."""
    return p5_reasons(spark, d).groupBy("reason", "evidence").agg(F.count("*").alias("n"))


def p5_hand_written(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.hand_written(table(spark, d, "documents")).select("doc_id", "repo", "path")


def p7_packs(spark: SparkSession, d: str) -> DataFrame:
    return packing.packs(table(spark, d, "documents"), table(spark, d, "token_limits"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_packs(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_longest(spark, d).select("doc_id", "item_id")


def p8_longest(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return leakage.without_leaks(documents.select("doc_id"), leakage.leaks(documents, table(spark, d, "eval_items")))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_all(table(spark, d, "documents"), table(spark, d, "token_limits"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p4_found, p4_pairs, p5_found, p5_reasons, p5_evidence, p5_hand_written, p7_packs, p7_fill, p8_found, p8_longest, p8_clean, p9_pieces)
}
ORACLES: dict[str, str] = {}
