"""Chunks joined to the elements of a document's layout: by equal text, containment, likeness, page; then by priority."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.substrings import SHORTEST, Substrings
from docflow.functions.text import normalize
from docflow.session import materialize, ship

THRESHOLD, PAGE_TOLERANCE, ACCEPTED = 0.7, 2, 0.3
FUZZY_ELEMENTS, PAGE_ELEMENTS = 50, 20
SHORT, MOST_ELEMENTS = 5, 3000
#: Characters of a document's elements that one task holds as an index.
ELEMENT_CHARS = 1 << 26


def match_exact(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """chunk_id, element_id of the last element with the same normalised text in the document."""
    last = elements.groupBy("doc_id", normalize(F.col("text")).alias("norm")).agg(F.max("idx").alias("idx"))
    return chunks.withColumn("norm", normalize(F.col("content"))).join(last, ["doc_id", "norm"]).select("chunk_id", "idx", F.lit("content_exact").alias("method"), F.lit(1.0).alias("confidence"))


def match_contains(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """The first element that the chunk contains, of 10 to max(half the chunk, 20) characters.

    Distinct elements of a document are held as one index (functions/substrings), in parts of ELEMENT_CHARS, and its chunks pass by in
    a stream, so that the work grows with the characters and not with chunks times elements.
    """
    spark = chunks.sparkSession
    ship(spark)
    norm = normalize(F.col("text"))
    e = elements.select("doc_id", "idx", norm.alias("norm")).where(F.length("norm") >= SHORTEST).groupBy("doc_id", "norm").agg(F.min("idx").cast("long").alias("idx"))
    most = elements.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = 1 + most // ELEMENT_CHARS
    e = e.select("doc_id", F.pmod(F.xxhash64("norm"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "norm", "idx", F.lit(None).cast(chunks.schema["chunk_id"].dataType).alias("chunk_id"))
    c = chunks.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), normalize(F.col("content")).alias("norm"), F.lit(None).cast("long").alias("idx"), "chunk_id")
    rows = e.union(c.where(F.col("norm").isNotNull() & F.col("doc_id").isNotNull())).repartition("doc_id", "part").sortWithinPartitions("doc_id", "part", "kind")

    def run(batches):
        key, held, index, idx = None, [], None, None
        for batch in batches:
            doc, part, kind = (batch.column(i) for i in range(3))
            change = np.flatnonzero(np.diff(doc.dictionary_encode().indices.to_numpy()) | np.diff(part.to_numpy()) | np.diff(kind.to_numpy())) + 1
            for a, b in pairwise([0, *change.tolist(), batch.num_rows]):
                if b == a:
                    continue
                if (now := (doc[a].as_py(), part[a].as_py())) != key:
                    key, held, index = now, [], None
                rows = batch.slice(a, b - a)
                if kind[a].as_py() == 0:
                    held.append(rows.select([3, 4]))
                elif held:
                    table = pa.Table.from_batches(held)
                    if index is None:
                        table = table.sort_by("idx").combine_chunks()
                        idx, index = table.column("idx").to_numpy(), Substrings(table.column("norm").combine_chunks())
                        held = held[:1]
                    longest = np.maximum(pc.utf8_length(rows.column(3)).to_numpy() // 2, 20)
                    found = index.first(rows.column(3), longest)
                    hit = np.flatnonzero(found >= 0)
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([rows.column(5).take(pa.array(hit)), pa.array(idx[found[hit]])], ["chunk_id", "idx"])

    found = rows.mapInArrow(run, f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, idx long")
    return found.groupBy("chunk_id").agg(F.min("idx").cast(elements.schema["idx"].dataType).alias("idx")).select("chunk_id", "idx", F.lit("content_contains").alias("method"), F.lit(0.9).alias("confidence"))


def match_fuzzy(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """The most similar of the first 50 elements of 10 to 150 characters, by longest matching blocks."""
    early = elements.where(F.length("text").between(10, 150)).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))).where(F.col("n") <= FUZZY_ELEMENTS)
    e = early.select("doc_id", "idx", normalize(F.col("text")).alias("enorm"))
    pairs = chunks.withColumn("norm", normalize(F.col("content"))).join(e, "doc_id")
    ratio = F.least(F.length("norm"), F.length("enorm")) / F.greatest(F.length("norm"), F.length("enorm"))

    @F.pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0.8 if len(y) < 50 and (y in x or x in y) else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    scored = pairs.where(ratio >= 0.3).withColumn("s", likeness("norm", "enorm")).where(F.col("s") >= THRESHOLD)
    # the scan ends at the first element over 0.95; else the best, the first of equals
    best = scored.groupBy("chunk_id").agg(F.min(F.when(F.col("s") > 0.95, F.struct("idx", "s"))).alias("sure"), F.max_by(F.struct("idx", "s"), F.struct("s", -F.col("idx"))).alias("top"))
    pick = F.coalesce("sure", "top")
    return best.select("chunk_id", pick["idx"].alias("idx"), F.lit("content_fuzzy").alias("method"), pick["s"].alias("confidence"))


def match_page(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """The first of the first 20 elements whose page is within two; 0.6 on the same page, else 0.4."""
    e = elements.where((F.col("idx") < PAGE_ELEMENTS) & F.col("page").isNotNull()).select("doc_id", "idx", F.col("page").alias("epage"))
    near = chunks.join(e, "doc_id").where(F.abs(F.col("page") - F.col("epage")) <= PAGE_TOLERANCE)
    first = near.groupBy("chunk_id").agg(F.min(F.struct("idx", (F.col("page") == F.col("epage")).alias("same"))).alias("m"))
    return first.select("chunk_id", "m.idx", F.lit("position").alias("method"), F.when(F.col("m.same"), 0.6).otherwise(0.4).alias("confidence"))


def match_priority(chunks: DataFrame, elements: DataFrame, fuzzy: bool = True) -> DataFrame:
    """The first kind of match that there is, for every chunk. Each kind is computed once; the fuzzy one, which costs most, sees
    only the chunks that no other kind of equal text found, and these are written to the shared folder."""

    def first(*found: tuple[int, DataFrame]) -> DataFrame:
        every = reduce(DataFrame.unionByName, [rows.where(F.col("confidence") > ACCEPTED).withColumn("rank", F.lit(rank)) for rank, rows in found])
        best = every.groupBy("chunk_id").agg(F.min(F.struct("rank", "idx", "method", "confidence")).alias("b"))
        return best.select("chunk_id", "b.idx", "b.method", "b.confidence", "b.rank")

    same = [(0, match_exact(chunks, elements)), (1, match_contains(chunks, elements))]
    if fuzzy:
        sure = materialize(first(*same), "matches")
        left = chunks.join(sure.select("chunk_id"), "chunk_id", "left_anti")
        same = [(0, sure.drop("rank")), (2, match_fuzzy(left, elements))]
    return chunks.select("chunk_id").join(first(*same, (3, match_page(chunks, elements))).drop("rank"), "chunk_id", "left")


def usable_elements(elements: DataFrame) -> DataFrame:
    """elements of more than 5 characters, the first 3,000 of a document, which is a limit of the feature itself."""
    long_ = elements.where(F.length(F.trim("text")) > SHORT)
    return long_.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))).where(F.col("_n") <= MOST_ELEMENTS).drop("_n")


def layout_elements(layouts: DataFrame) -> DataFrame:
    """doc_id, idx, text, page of texts, tables, figures, then the elements that the body refers to (again)."""
    el = lambda c: F.transform(c, lambda x: F.struct(x["text"].alias("text"), F.coalesce(x["page"], x["page_no"], F.get(x["prov"], 0)["page_no"], F.get(x["prov"], 0)["page"], F.lit(0)).alias("page"), x["level"].alias("level")))
    tables = F.transform("layout.tables", lambda x: F.struct(x["label"].alias("text"), F.coalesce(F.get(x["prov"], 0)["page_no"], F.get(x["prov"], 0)["page"], F.lit(0)).alias("page"), F.lit(None).cast("int").alias("level")))
    none = F.array().cast("array<struct<text:string,page:int,level:int>>")
    texts, figures = F.coalesce(el("layout.texts"), none), F.coalesce(el("layout.figures"), none)
    tables = F.coalesce(tables, none)
    refs = F.coalesce(F.transform("layout.body.children", lambda c: c["$ref"]), F.array().cast("array<string>"))
    at = lambda r: F.regexp_extract(r, r"/(\d+)$", 1).cast("int")
    referred = F.array_compact(F.transform(refs, lambda r: F.when(r.startswith("#/texts/"), F.get(texts, at(r))).when(r.startswith("#/tables/"), F.get(tables, at(r))).when(r.startswith("#/figures/"), F.get(figures, at(r)))))
    return layouts.select("doc_id", F.posexplode(F.concat(texts, tables, figures, referred)).alias("idx", "e")).select("doc_id", "idx", "e.text", "e.page", "e.level")


__all__ = ["layout_elements", "match_contains", "match_exact", "match_fuzzy", "match_page", "match_priority", "usable_elements"]
