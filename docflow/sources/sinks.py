"""Writers: store rows, processed chunks, sample exports, history, and the chunk store itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.text import preview
from docflow.functions.vectors import dimension

CONTENT_CAP, FIELD_CAP = 65_535, 32_766


def store_rows(chunks: DataFrame) -> DataFrame:
    """K4: content cut, defaults for what is missing, lists as JSON; nulls stay nulls everywhere but here."""
    as_json = lambda c: F.coalesce(F.to_json(F.col(c)), F.lit("[]")).alias(c)
    return chunks.select(
        "chunk_id", "doc_id", F.substring("content", 1, CONTENT_CAP).alias("content"), F.coalesce("word_count", F.lit(0)).alias("word_count"), as_json("section_path"),
        F.coalesce("chunk_type", F.lit("text")).alias("chunk_type"), F.coalesce("product_version", F.lit("v1")).alias("product_version"), F.col("doc_id").alias("source"),
        F.coalesce("page", F.lit(0)).alias("page"), as_json("dates"), as_json("regions"),
    )


def write_processed(chunks: DataFrame, path: str) -> None:
    """K1: one JSON object a chunk, without null fields, with the dimension of its embedding."""
    chunks.withColumn("embedding_dim", dimension(F.col("embedding"))).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def export_sample(chunks: DataFrame, metadata_only: bool = False) -> DataFrame:
    """With metadata_only a preview stands for the content."""
    return chunks.withColumn("content_preview", preview(F.col("content"))).drop("content") if metadata_only else chunks


def summary(chunks: DataFrame, text: Column, words: Column, tokens: Column) -> DataFrame:
    """K2, A4: chunks, mean words, total tokens."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.round(F.avg(words), 6).alias("mean_words"), F.sum(tokens).alias("total_tokens"), F.max(F.length(text)).alias("longest"))


class ChunkStore:
    """A collection of chunks in a Parquet folder. Appends are added files; deletes and clears write a new folder version and
    then move the pointer, so a reader sees the one or the other."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _pointer(self) -> str:
        return f"{self.path}/_versions"

    def version(self) -> int:
        try:
            return self.spark.read.schema("version int").json(self._pointer()).agg(F.max("version")).first()[0] or 0
        except Exception as e:  # no version was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0

    def _data(self, version: int) -> str:
        return f"{self.path}/v{version}"

    def rows(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(self.schema).parquet(self._data(v)) if v else self.spark.createDataFrame([], self.schema)

    def _replace(self, rows: DataFrame) -> None:
        v = self.version() + 1
        rows.write.mode("overwrite").parquet(self._data(v))
        self.spark.range(1).select(F.lit(v).alias("version")).coalesce(1).write.mode("append").json(self._pointer())

    def create(self, drop_if_exists: bool = False) -> None:
        if drop_if_exists or not self.version():
            self._replace(self.spark.createDataFrame([], self.schema))

    def insert(self, rows: DataFrame) -> None:
        self.create()
        rows.select(*self.rows().columns).write.mode("append").parquet(self._data(self.version()))

    def delete(self, keys: DataFrame, key: str) -> None:
        self._replace(self.rows().join(keys.select(key), key, "left_anti").select(*self.rows().columns))

    def clear(self, confirm: bool = False) -> tuple[int, int]:
        """Counts before and after; refuses without confirm."""
        if not confirm:
            raise ValueError("clear needs confirm=True")
        before = self.count()
        self.create(drop_if_exists=True)
        return before, self.count()

    def drop(self, confirm: bool = False) -> None:
        """The folder goes with all versions; refuses without confirm, and where it holds no store."""
        if not confirm:
            raise ValueError("drop needs confirm=True")
        if self.version():
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def count(self) -> int:
        return self.rows().count()

    def stats(self) -> DataFrame:
        return self.rows().agg(F.count("*").alias("row_count"))

    def healthy(self) -> bool:
        return self.rows().columns == self.spark.createDataFrame([], self.schema).columns


def write_cells(indexed: DataFrame, path: str) -> None:
    """K6: an inverted-file index, one folder for each cell, so that a probe reads only its cells."""
    indexed.write.mode("overwrite").partitionBy("cell").parquet(path)
