"""The driver's tables in the roles the queries need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled utterances: documents with a label."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id")


def stepped_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Line items scored by discount: few distinct scores, as tree votes give."""
    return table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_discount").alias("score"),
        (F.col("l_discount") >= 0.05).cast("int").alias("predicted"))


def fine_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Orders scored by price: nearly every score is distinct."""
    return table(spark, sf, "orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("priority"),
        (F.col("o_totalprice") >= 250000).cast("int").alias("predicted"))


def six(column: str):
    """Six decimals, for comparison across engines."""
    return F.round(column, 6).alias(column)


LABELLED = """labelled AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

STEPPED = """scored AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount AS score,
         CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS predicted
  FROM lineitem)"""

FINE = """scored AS (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice AS score,
         o_orderpriority AS priority,
         CASE WHEN o_totalprice >= 250000 THEN 1 ELSE 0 END AS predicted
  FROM orders)"""
