"""The chunks of documents that did not change are read back instead of made again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ChunkCache:
    """Chunks by document and the hash of its text, in a Parquet folder.

    Writes are appends, each committed as a whole; an entry counts only for a text of its hash, so what is out of date is not read.
    A document whose text gives no chunk is made again each time. A null text is an empty one.
    """

    def __init__(self, spark: SparkSession, path: str, chunk: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.chunk = spark, path.rstrip("/"), chunk

    def _stored(self, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def chunks(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The chunks of docs (doc_id, text); those that the cache lacks are made and added. A document that is given twice counts once."""
        keyed = docs.select("doc_id", F.col(text).alias("text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("doc_hash")).dropDuplicates(["doc_id", "doc_hash"])
        keys = keyed.select("doc_id", "doc_hash")
        schema = self.chunk(keyed.limit(0).select("doc_id", "text")).withColumn("doc_hash", F.lit("")).schema
        known = self._stored(schema).select("doc_id", "doc_hash").distinct()
        fresh = keyed.join(known, ["doc_id", "doc_hash"], "left_anti")
        made = self.chunk(fresh.select("doc_id", "text")).join(fresh.select("doc_id", "doc_hash"), "doc_id")
        made.select(*schema.names).write.mode("append").parquet(self.path)
        return self._stored(schema).join(keys, ["doc_id", "doc_hash"], "left_semi").drop("doc_hash")

    def clear(self, confirm: bool = False) -> None:
        """Refuses without confirm."""
        if not confirm:
            raise ValueError("clear needs confirm=True")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
