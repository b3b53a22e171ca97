"""Duplicate analysis and removal, incremental ingestion, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.operators.search import keep_first


def duplicate_counts(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_summary(rows: DataFrame, key: str) -> DataFrame:
    """A1: total rows, distinct keys, keys with duplicates, surplus rows; counted from one row for each key."""
    each = rows.groupBy(key).agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("duplicated_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def content_groups(rows: DataFrame, content: str = "text") -> DataFrame:
    """A2: groups of equal content by SHA-256."""
    return rows.groupBy(F.sha2(F.col(content), 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def remove_duplicates(rows: DataFrame, key: list[str], order: list[Column], dry_run: bool = False) -> DataFrame:
    """A3, K9: the rows that stay; with dry_run those that would go."""
    if not dry_run:
        return keep_first(rows, key, order)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n > 1").drop("_n")


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """U8: for each key the values of its last row in a stated order, and how many rows were merged; combined before the shuffle."""
    values = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return rows.groupBy(*key).agg(last, F.count("*").alias("merged")).select(*key, "_last.*", "merged")


def unprocessed(files: DataFrame, processed: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Files whose fingerprint is not known."""
    return files.join(processed.select(key), key, "left_anti")


def missing(rows: DataFrame, embedded: DataFrame, key: str) -> DataFrame:
    """rows without an embedding."""
    return rows.join(embedded.where(F.size("embedding") > 0).select(key), key, "left_anti")


def backfill(rows: DataFrame, encode) -> DataFrame:
    """Every row without an embedding gets one; encode turns a text column into a vector column."""
    return rows.withColumn("embedding", F.coalesce(F.when(F.size("embedding") > 0, F.col("embedding")), encode(F.col("content"))))
