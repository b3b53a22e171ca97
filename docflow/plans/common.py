"""Registration of named queries and pieces of SQL that several of them share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql_words(t: str) -> str:
    return rf"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"


def sql_tokens(t: str) -> str:
    return f"CAST(floor(len({sql_words(t)}) * 1.3::DOUBLE + length({t}) * 0.1::DOUBLE) AS INTEGER)"


def sql_trim(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def sql_preview(t: str, n: int = 200) -> str:
    return f"CASE WHEN length({t}) > {n} THEN substring({t}, 1, {n}) || '...' ELSE {t} END"


#: A markdown document made of each row of documents, in Spark and in SQL.
MARKDOWN_SQL = """(SELECT doc_id, '# Report ' || doc_id || chr(10) || chr(10) || 'Table of contents' || chr(10) || '1. Opening' || chr(10) || 'Opening ..... ' || (1 + doc_id % 9) || chr(10)
  || 'Results    ' || (3 + doc_id % 5) || chr(10) || '| Annex | notes | ' || (7 + doc_id % 3) || ' |' || chr(10) || '2. Results' || chr(10) || '    Part two .... 12' || chr(10) || chr(10)
  || '## Opening' || chr(10) || text || chr(10) || '### Detail ' || (doc_id % 7) || chr(10) || 'More words follow here. They end.' || chr(10) || '## Results' || chr(10) || text AS text FROM documents)"""


def markdown(docs) -> Column:
    n, d = F.lit("\n"), F.col("doc_id")
    s = lambda c: c.cast("string")
    text = F.concat(
        F.lit("# Report "), s(d), F.lit("\n\nTable of contents\n1. Opening\nOpening ..... "), s(1 + d % 9), F.lit("\nResults    "), s(3 + d % 5), F.lit("\n| Annex | notes | "), s(7 + d % 3), F.lit(" |\n2. Results\n    Part two .... 12\n\n## Opening\n"),
        F.col("text"), F.lit("\n### Detail "), s(d % 7), F.lit("\nMore words follow here. They end.\n## Results"), n, F.col("text"),
    )
    return docs.select("doc_id", text.alias("text"))
