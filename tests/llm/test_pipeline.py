"""The pipeline's stages against plain Python."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from docflow.llm import packing
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import valid
from tests.llm.test_rules import measure

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_stages(spark, stages):
    docs, scored, ruled, single, packed = stages
    assert docs.columns == scored.columns == ruled.columns == single.columns
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    before, after = text(docs), text(scored)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in after for i in before if labels.get(i) == 1)
    assert sum(i in after for i in before if labels.get(i) == 0) <= 2
    assert text(ruled) == {i: t for i, t in after.items() if measure(t)[-1]}
    assert text(single) == {i: t for i, t in text(ruled).items() if brute_components(ruled)[i] == i}
    valid(packed.collect(), text(single), 2048)


_found = {}


def brute_components(df):
    if not _found:
        _found.update({i: c for i, (_, c) in brute({r.doc_id: r.text for r in df.collect()}, 5, 80, 100).items()})
    return _found


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == packing.pack(stages[3].limit(0), corpus_pipeline.public_tokenizers.path(corpus_pipeline.TOKENIZER)).columns
    key = lambda df: sorted((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert key(rows) == key(stages[4])


def test_odd_documents(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "", "x"), (1, "", "x"), (2, None, "x")], "doc_id long, text string, score string").withColumn("n", F.lit(None))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
