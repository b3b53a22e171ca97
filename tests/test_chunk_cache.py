"""Cached and fresh chunks, and the verbs of the command line on stores."""

import pytest
from pyspark.sql import functions as F

from docflow import __main__ as cli
from docflow.operators.chunk import chunk_documents
from docflow.sources import sinks
from docflow.sources.cache import ChunkCache

DOCS = "doc_id long, text string"


def rows(df):
    return sorted((r.doc_id, r.chunk_index, r.content) for r in df.collect())


def test_only_changed_documents_are_made_again(spark, tmp_path):
    cache = ChunkCache(spark, str(tmp_path / "cache"), chunk_documents)
    body = "Some words stand here. " * 90
    first = spark.createDataFrame([(1, body), (2, "Old text here."), (3, None), (4, ""), (1, body)], DOCS)
    assert rows(cache.chunks(first)) == rows(chunk_documents(first.dropDuplicates()))
    stored = spark.read.parquet(cache.path).count()
    assert rows(cache.chunks(first)) == rows(chunk_documents(first.dropDuplicates()))
    assert spark.read.parquet(cache.path).count() == stored
    second = spark.createDataFrame([(1, body), (2, "New text here."), (5, "One more.")], DOCS)
    assert rows(cache.chunks(second)) == rows(chunk_documents(second))
    assert rows(cache.chunks(second.limit(0))) == []
    with pytest.raises(ValueError):
        cache.clear()
    cache.clear(confirm=True)
    assert rows(cache.chunks(second)) == rows(chunk_documents(second))


def test_clear_and_drop_need_a_confirmation(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "build_session", lambda *_: spark)
    path, schema = str(tmp_path / "store"), "chunk_id string, content string"
    store = sinks.ChunkStore(spark, path, schema)
    store.insert(spark.createDataFrame([("a", "x"), ("b", "y")], schema))
    base = ["--store", path, "--schema", schema]
    cli.main(["clear", *base])
    assert capsys.readouterr().out == "2 rows\n" and store.count() == 2
    cli.main(["clear", *base, "--confirm"])
    assert store.count() == 0 and store.version() > 0
    cli.main(["drop", *base])
    assert store.version() > 0
    cli.main(["drop", *base, "--confirm"])
    assert store.version() == 0 and not (tmp_path / "store").exists()


def test_export_and_sample(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda *_: spark)
    chunks = spark.range(50).select(F.col("id").cast("string").alias("chunk_id"), F.lit("some words").alias("content"), F.array(F.lit(0.5)).alias("embedding"))
    chunks.write.parquet(str(tmp_path / "chunks"))
    cli.main(["export", "--chunks", str(tmp_path / "chunks"), "--output-dir", str(tmp_path / "json")])
    cli.main(["sample", "--chunks", str(tmp_path / "chunks"), "--output-dir", str(tmp_path / "some"), "--n", "7"])
    assert spark.read.json(str(tmp_path / "json")).where("embedding_dim = 1").count() == 50
    some = spark.read.json(str(tmp_path / "some"))
    assert some.count() == 7 and "content" not in some.columns and "content_preview" in some.columns
