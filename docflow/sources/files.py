"""Readers: document folders, layouts, processed chunks, pages of a collection, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.text import document_title, folder_path, is_supported, source_type, stem
from docflow.schema import LAYOUT, PROCESSED


def decode(content: Column) -> Column:
    """S3: UTF-8 where valid (without a byte-order mark), else Latin-1."""
    return F.regexp_replace(F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1")), "^\\uFEFF", "")


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every text, markdown and HTML file below path with its text and what its name tells, one row a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(is_supported(F.col("path")))
    p = F.col("path")
    return files.select(
        "path", "modificationTime", "length", decode(F.col("content")).alias("text"), stem(p).alias("doc_id"), document_title(p).alias("title"),
        source_type(p).alias("source_type"), folder_path(F.regexp_replace(p, "^.*" + path.rstrip("/").split("/")[-1] + "/", "")).alias("folder_path"),
    )


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and the layout of every JSON file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    return files.select(stem(F.col("path")).alias("doc_id"), F.from_json(F.col("content").cast("string"), LAYOUT).alias("layout"))


def with_layouts(docs: DataFrame, layouts: DataFrame) -> DataFrame:
    return docs.join(layouts, "doc_id", "left")


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of processed-chunk files."""
    return spark.read.schema(PROCESSED).option("multiLine", True).json(path).select(F.inline("chunks"))


def page_of(rows: DataFrame, key: str, offset: int, limit: int, columns: list[str]) -> DataFrame:
    """One page of a collection in the order of its key."""
    return rows.select(*columns).orderBy(key).offset(offset).limit(limit)


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows by a hash of their key, the same for the same seed."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), key).limit(n)
