"""Cleaning of chunks and merging of small neighbours, in column expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions.text import jaccard, word_count
from docflow.operators.structure import trimmed

# Artefacts, navigation and noise lines.
GLYPHS = "[�]|[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]|GLYPH<[^>]*>"
NAVIGATION = r"(?i)skip\s+to\s+(main\s+)?content|skip\s+to\s+homepage|toggle\s+navigation|breadcrumb|^\s*(home\s*[>›»]|[>›»])\s*"
NOISE = r"^\s*[-•·▪▫◦‣⁃]+\s*$|^\s*[─━═_]{3,}\s*$|^\s*\.{3,}\s*$|^\s*[^\w\s]{1,2}\s*$"
NAVIGATION_CHARS = 30
SMALL_WORDS, SIMILAR = 50, 0.6


def clean_text(text: Column) -> Column:
    """T14."""
    rows = F.split(F.regexp_replace(text, GLYPHS, " "), "\n")
    s = trimmed
    kept = F.filter(rows, lambda x: (s(x) == "") | ~(((F.length(s(x)) <= NAVIGATION_CHARS) & s(x).rlike(NAVIGATION)) | x.rlike(NOISE)))
    joined = F.array_join(F.transform(kept, lambda x: F.when(s(x) == "", "").otherwise(x)), "\n")
    spaced = F.regexp_replace(F.regexp_replace(joined, r"[ \t]{2,}", " "), r"(?m)[ \t]+$", "")
    return s(F.regexp_replace(spaced, r"\n{3,}", "\n\n"))


def is_prefix(a: Column, b: Column) -> Column:
    return F.slice(b, 1, F.size(a)) == a


def mergeable(path_a: Column, path_b: Column, text_a: Column, text_b: Column, legacy: bool = False) -> Column:
    """Equal paths, one a prefix of the other, or of one length with one level different; without any path always; else by the
    Jaccard similarity of the words. legacy: by the similarity alone."""
    similar = jaccard(text_a, text_b) > SIMILAR
    if legacy:
        return similar
    differing = F.size(F.filter(F.zip_with(path_a, path_b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x))
    related = (path_a == path_b) | is_prefix(path_a, path_b) | is_prefix(path_b, path_a) | ((F.size(path_a) == F.size(path_b)) & (differing <= 1))
    return F.when((F.size(path_a) == 0) & (F.size(path_b) == 0), True).when(related, True).otherwise(similar)


def merge_small(chunks: DataFrame, legacy: bool = False) -> DataFrame:
    """Chunks (doc_id, chunk_index, section_path, content), each small one merged with the next if they go together.

    A scan from left to right that never merges a chunk twice merges at the first, third, ... of each run of true flags, so it
    is two windows instead of a loop.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    nxt = chunks.withColumn("next_path", F.lead("section_path").over(order)).withColumn("next_content", F.lead("content").over(order))
    flag = F.col("next_content").isNotNull() & (word_count(F.col("content")) < SMALL_WORDS) & F.coalesce(mergeable(F.col("section_path"), F.col("next_path"), F.col("content"), F.col("next_content"), legacy), F.lit(False))
    flagged = nxt.withColumn("flag", flag.cast("int")).withColumn("island", F.sum(1 - F.col("flag")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - (1 - F.col("flag")))
    run = Window.partitionBy("doc_id", "island").orderBy("chunk_index")
    merged = flagged.withColumn("at", F.row_number().over(run)).withColumn("merges", (F.col("flag") == 1) & (F.col("at") % 2 == 1))
    gone = F.coalesce(F.lag("merges").over(order), F.lit(False))
    out = merged.withColumn("gone", gone).where(~F.col("gone"))
    longer = F.when(F.size("next_path") > F.size("section_path"), F.col("next_path")).otherwise(F.col("section_path"))
    content = F.when(F.col("merges"), F.concat("content", F.lit("\n\n"), "next_content")).otherwise(F.col("content"))
    return out.select("doc_id", "chunk_index", F.when(F.col("merges"), longer).otherwise(F.col("section_path")).alias("section_path"), content.alias("content"), "merges")
