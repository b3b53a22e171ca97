"""The retrieval pipeline and ingestion as lazily planned jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.config import ChunkConfig, SearchConfig
from docflow.functions import entities
from docflow.functions.encode import hashing_encoder
from docflow.functions.text import prompt, word_count
from docflow.operators.chunk import chunk_under_headings
from docflow.operators.clean import clean_text
from docflow.operators.context import LanguageModel, build_context, generate
from docflow.operators.search import two_stage
from docflow.sources.files import scan_documents

# Fixed value.
SYSTEM = "You are a helpful assistant that answers questions from the given context."


def ingest(spark: SparkSession, path: str, config: ChunkConfig = ChunkConfig(), encode: Callable[[Column], Column] = hashing_encoder) -> DataFrame:
    """Files to cleaned, enriched, embedded chunks; one job, tasks by file."""
    docs = scan_documents(spark, path).where(F.length(F.trim("text")) > 0)
    chunks = chunk_under_headings(docs, config).withColumn("content", clean_text(F.col("content"))).where(F.col("content") != "")
    return with_entities(chunks.withColumn("word_count", word_count(F.col("content")))).withColumn("embedding", encode(F.col("content")).cast("array<float>"))


def with_entities(chunks: DataFrame, content: str = "content") -> DataFrame:
    """E1-E6, P13 as columns of each chunk."""
    c = F.col(content)
    found = chunks.withColumns({"dates": entities.dates(c), "time_periods": entities.time_periods(c), "metrics": entities.metrics(c), "regions": entities.regions(c), "people": entities.people(c), "orgs": entities.organizations(c)})
    return found.withColumn("time_context", entities.time_context(F.col("dates")))


class RagPipeline:
    """Questions (query_id, query) to answers over chunks (vec_id, chunk_key, doc_id, section, content, embedding)."""

    def __init__(self, chunks: DataFrame, encode: Callable[[Column], Column] = hashing_encoder, model: LanguageModel | None = None, config: SearchConfig = SearchConfig()):
        self.chunks, self.encode, self.model, self.config = chunks, encode, model, config

    def retrieve(self, questions: DataFrame) -> DataFrame:
        asked = questions.withColumn("q", self.encode(F.col("query")))
        return two_stage(asked, self.chunks.select("vec_id", "embedding"), self.chunks.select("vec_id", "chunk_key", "doc_id", "section", "content"), self.config)

    def query(self, questions: DataFrame) -> DataFrame:
        """query_id, query, answer, n_chunks, context_tokens; a question without context is asked without."""
        found = self.retrieve(questions).select("query_id", (F.col("final_rank") + 1).alias("rank"), F.col("doc_id").cast("string").alias("source"), "section", F.col("rerank_probability").alias("score"), "content")
        context = build_context(found, self.config.max_context_tokens)
        asked = questions.join(context, "query_id", "left").withColumn("prompt", prompt(F.lit(SYSTEM), F.coalesce("context", F.lit("No relevant context was found.")), F.col("query")))
        return generate(asked, self.model).select("query_id", "query", "answer", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("context_tokens", F.lit(0)).alias("context_tokens"))
