"""Operators that need a model: entity recognition, pair scoring, contents verification, table titles.

Each takes an injected object and runs it on Arrow batches; the offline defaults are deterministic rules. No network is used here.
"""

from __future__ import annotations

import time
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions import entities as e
from docflow.functions.text import caption_heading, fallback_summary, pair_hash
from docflow.operators.search import lexical_score

CLASSES = ("organizations", "locations", "products", "events")
#: Characters of a chunk that are read, the least that are worth it, entities of each class.
NER_CHARS, NER_LEAST, NER_EACH = 1200, 50, 3


class EntityModel(Protocol):
    def predict(self, texts: list[str]) -> list[dict[str, list[str]]]:
        """For each text, lists of strings by class."""


class PairScorer(Protocol):
    def score(self, queries: list[str], contents: list[str]) -> list[float]:
        """A logit for each pair."""


class SectionVerifier(Protocol):
    def confidence(self, sections: list[str]) -> list[float]:
        """How sure it is, 0 to 1, that each section is a table of contents."""


def entity_columns(content: Column) -> Column:
    """The rule layer as the offline model: company names and regions."""
    none = F.array().cast("array<string>")
    return F.struct(e.organizations(content).alias("organizations"), e.regions(content).alias("locations"), none.alias("products"), none.alias("events"))


def tidy_entities(raw: Column) -> Column:
    """Usable strings; products that were taken for organisations are moved; sorted, three of each class."""
    orgs = F.filter(raw["organizations"], e.usable_entity)
    moved = F.filter(orgs, e.is_product)
    three = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, NER_EACH)
    return F.struct(
        three(F.array_except(orgs, moved)).alias("organizations"), three(F.filter(raw["locations"], e.usable_entity)).alias("locations"),
        three(F.concat(F.filter(raw["products"], e.usable_entity), moved)).alias("products"), three(F.filter(raw["events"], e.usable_entity)).alias("events"),
    )


def with_ner(chunks: DataFrame, model: EntityModel | None = None) -> DataFrame:
    """Chunks with a column ner; chunks of under 50 characters get empty lists."""
    text = F.substring("content", 1, NER_CHARS)
    if model is None:
        raw = entity_columns(text)
    else:

        @F.pandas_udf("organizations array<string>, locations array<string>, products array<string>, events array<string>")
        def predict(texts: pd.Series) -> pd.DataFrame:
            found = model.predict(list(texts))
            return pd.DataFrame({c: [list(x.get(c, [])) for x in found] for c in CLASSES})

        raw = predict(text)
    none = F.array().cast("array<string>")
    empty = F.struct(*[none.alias(c) for c in CLASSES])
    return chunks.withColumn("_raw", raw).withColumn("ner", F.when(F.length("content") < NER_LEAST, empty).otherwise(tidy_entities(F.col("_raw")))).drop("_raw")


def pair_scores(pairs: DataFrame, scorer: PairScorer | None = None, known: DataFrame | None = None) -> DataFrame:
    """Pairs (query, content, ...) with a logit. known (pair_key, logit) is a stored table of earlier scores: only pairs that it
    lacks are scored."""
    keyed = pairs.withColumn("pair_key", pair_hash(F.col("query"), F.col("content")))
    if scorer is None:
        logit = lexical_score(F.col("query"), F.col("content"))
    else:

        @F.pandas_udf("double")
        def run(q: pd.Series, c: pd.Series) -> pd.Series:
            return pd.Series(scorer.score(list(q), list(c)), dtype="float64")

        logit = run("query", "content")
    if known is None:
        return keyed.withColumn("logit", logit)
    done = keyed.join(known, "pair_key")
    return done.unionByName(keyed.join(known, "pair_key", "left_anti").withColumn("logit", logit))


def verified(candidates: DataFrame, sections: Column, verifier: SectionVerifier | None = None, least: float = 0.3) -> DataFrame:
    """Without a verifier as they are; else those it is sure enough of, raised by half of its confidence."""
    if verifier is None:
        return candidates

    @F.pandas_udf("double")
    def ask(s: pd.Series) -> pd.Series:
        return pd.Series(verifier.confidence(list(s)), dtype="float64")

    sure = candidates.withColumn("confidence", ask(sections)).where(F.col("confidence") >= least)
    return sure.withColumn("score", F.col("score") + 0.5 * F.col("confidence"))


def table_titles(tables: DataFrame, model=None) -> DataFrame:
    """Tables (table_id, caption, markdown) with title and summary: by the model from the first 1,000 characters, else from the caption."""
    titled = tables.withColumn("title", caption_heading(F.col("caption"))).withColumn("summary", fallback_summary(F.col("caption")))
    if model is None:
        return titled

    @F.pandas_udf("string")
    def ask(s: pd.Series) -> pd.Series:
        return pd.Series(model.generate(list(s)))

    return titled.withColumn("title", F.coalesce(ask(F.substring("markdown", 1, 1000)), F.col("title")))


def benchmark(run, repeats: int = 5) -> dict[str, float]:
    """Mean, standard deviation, least and most seconds of an action."""
    import statistics

    seconds = []
    for _ in range(repeats):
        began = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - began)
    return {"mean": statistics.mean(seconds), "std": statistics.stdev(seconds) if repeats > 1 else 0.0, "min": min(seconds), "max": max(seconds)}


def overhead_pct(base: dict[str, float], other: dict[str, float]) -> float:
    return (other["mean"] - base["mean"]) / base["mean"] * 100
