"""Queries of the operators on texts, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.llm.leaks import leaked_items
from siftlake.llm.packing import CAPACITY, fill_report, pack_documents
from siftlake.llm.splitting import LIMIT, OVERLAP, split_documents


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(_table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which a second piece was packed."""
    return p6_pack(spark, d).filter("piece_no = 1").select("doc_id")


def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document's pieces and tokens as packed."""
    return p6_pack(spark, d).groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p6_pack(spark, d)).select("tokens", "least_containers", "overfull", (F.col("containers") <= 1.02 * F.col("least_containers") + 2).alias("tight"))


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_scores(spark, d).select("doc_id", "item_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(_table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which there is a second piece."""
    return p8_pieces(spark, d).filter("piece_no = 1").select("doc_id")


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each split document: tokens covered, and whether all lengths and overlaps hold."""
    before = F.lag("end_token").over(Window.partitionBy("doc_id").orderBy("piece_no"))
    pieces = p8_pieces(spark, d).withColumn("shared", before - F.col("start_token"))
    length = F.col("end_token") - F.col("start_token")
    return pieces.groupBy("doc_id").agg(
        F.sum(length - F.coalesce("shared", F.lit(0))).alias("tokens"),
        F.max("end_token").alias("last_token"),
        F.bool_and((length <= LIMIT) & (length == F.octet_length("text"))).alias("lengths_hold"),
        F.bool_and(F.coalesce(F.col("shared").between(OVERLAP - 3, OVERLAP), F.col("start_token") == 0)).alias("overlaps_hold"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p6_found, p6_pack, p6_documents, p6_fill, p7_found, p7_scores, p8_found, p8_pieces, p8_documents)
}

_SIZE = "coalesce(strlen(text), 0)"
SQL: dict[str, str] = {
    "p6_found": f"SELECT doc_id FROM documents WHERE {_SIZE} > {CAPACITY}",
    "p6_documents": f"SELECT doc_id, CAST(greatest(1, ceil({_SIZE} / {CAPACITY})) AS BIGINT) AS pieces, {_SIZE} AS tokens FROM documents",
    "p6_fill": f"SELECT sum({_SIZE}) AS tokens, CAST(ceil(sum({_SIZE}) / {CAPACITY}) AS BIGINT) AS least_containers, 0 AS overfull, true AS tight FROM documents",
    "p8_found": f"SELECT doc_id FROM documents WHERE {_SIZE} > {LIMIT}",
    "p8_documents": f"SELECT doc_id, {_SIZE} AS tokens, {_SIZE} AS last_token, true AS lengths_hold, true AS overlaps_hold FROM documents WHERE {_SIZE} > {LIMIT}",
}
