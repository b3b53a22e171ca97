"""Context building, answers and history: token budgets, formatting, injected language models."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docflow.config import HISTORY_LENGTH
from docflow.functions.text import token_estimate


class LanguageModel(Protocol):
    """X11: what an injected model must do; called on executors with lists of prompts."""

    def generate(self, prompts: list[str]) -> list[str]: ...


class MockModel:
    """The offline default: says how long the prompt is."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [f"[mock answer to {len(p)} characters]" for p in prompts]


def within_budget(rows: DataFrame, tokens: Column, max_tokens: int = 4000, by: tuple[str, ...] = ("query_id",), order: str = "rank") -> DataFrame:
    """The longest prefix of each query whose tokens sum to max_tokens at most. Sums only grow, so a filter is the same as stopping."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("tokens", tokens).withColumn("running_tokens", F.sum("tokens").over(w)).where(F.col("running_tokens") <= max_tokens)


def three_digits(score: Column) -> Column:
    """As printf("%.3f") rounds, by the value that the double has: 0.4165 is a little less than that. Java's formatter rounds the shortest
    decimal text up, and its DecimalFormat takes 0.0005 for a tie."""
    return F.when(score.isNotNull(), F.pandas_udf(lambda s: s.map("{:.3f}".format), "string")(score.cast("double"))).otherwise("null")


def format_chunk(position: Column, source: Column, section: Column, score: Column, content: Column) -> Column:
    """P34."""
    return F.concat(F.format_string("Document %d:\n(Source: %s | Section: %s | Relevance: %s)\n", position, source, section, three_digits(score)), content)


def build_context(ranked: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """query_id, context, n_chunks, context_tokens from ranked rows (query_id, rank, source, section, score, content)."""
    fit = within_budget(ranked, token_estimate(F.col("content")), max_tokens)
    part = F.struct("rank", format_chunk(F.col("rank"), F.col("source"), F.col("section"), F.col("score"), F.col("content")).alias("text"))
    return fit.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(part))["text"], "\n\n").alias("context"), F.count("*").alias("n_chunks"), F.sum("tokens").alias("context_tokens"))


def generate(prompts: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """prompts with an answer column; the model runs on batches."""
    model = model or MockModel()

    def run(batches):
        for pdf in batches:
            yield pdf.assign(answer=model.generate(list(pdf["prompt"])))

    return prompts.mapInPandas(run, StructType([*prompts.schema.fields, StructField("answer", StringType())]))


def last_history(history: DataFrame, key: str, order: Column, n: int = HISTORY_LENGTH) -> DataFrame:
    """The n most recent entries of each key."""
    return history.withColumn("recency", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("recency") <= n)
